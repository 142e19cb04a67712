"""The catalogue of queries and the SQL they are held against."""
