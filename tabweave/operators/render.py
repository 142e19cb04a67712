"""HTML of tables, and plans of renders and noise; drawing itself is for a browser behind an interface."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cell_name

STYLES = 60

#: Real parameters of noise and their ranges.
REAL = {
    "rotation": (-2, 2), "skew": (-0.7, 0.7), "perspective_scale": (0.002, 0.09), "blur_sigma": (0, 0.08), "downscale_factor": (0.98, 1), "salt_pepper_p": (0.00001, 0.0009),
    "gaussian_noise_scale": (0.0002, 0.003), "brightness_multiply": (0.95, 1.05), "scan_line_opacity": (0.05, 0.25), "corner_shadow_intensity": (0.15, 0.4), "color_shift_amount": (5, 20), "ink_bleed_intensity": (0.3, 0.8),
}
#: Whole parameters and their ranges.
WHOLE = {"num_scan_lines": (2, 8), "num_corner_shadows": (1, 3), "jpeg_quality": (75, 95), "num_dust_spots": (5, 25), "num_bands": (2, 5)}
#: Stages and their chances, in the order in which they are applied.
STAGES = {
    "perspective": 0.5, "affine": 0.4, "texture": 0.85, "blur": 0.3, "brightness": 0.5, "contrast": 0.4, "blend": 0.3, "edge_fade": 0.4, "speckle": 0.6, "rescale": 1.0,
    "paper_texture": 0.7, "ink_bleed": 0.25, "dust_spots": 0.5, "scan_lines": 0.6, "horizontal_bands": 0.35, "corner_shadows": 0.5, "page_curl": 0.2, "color_shift": 0.3, "jpeg_artifacts": 0.4,
}


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html(columns: Column, data: Column) -> Column:
    """A table element with an id for each header and cell."""
    head = F.array_join(F.transform(columns, lambda c, i: F.concat(F.lit('<th id="cell-h-'), i.cast("string"), F.lit('">'), escape(F.coalesce(c, F.lit(""))), F.lit("</th>"))), "")

    def row(r: Column, i: Column) -> Column:
        cells = F.transform(r, lambda c, j: F.concat(F.lit('<td id="'), cell_name(i, j), F.lit('">'), escape(F.coalesce(c, F.lit(""))), F.lit("</td>")))
        return F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>"))

    return F.concat(F.lit("<table><thead><tr>"), head, F.lit("</tr></thead><tbody>"), F.array_join(F.transform(data, row), ""), F.lit("</tbody></table>"))


#: Looks of a table; a style is one of each: 5 x 4 x 3 = STYLES.
FONTS = ["Arial, sans-serif", "Georgia, serif", "'Courier New', monospace", "Verdana, sans-serif", "'Times New Roman', serif"]
#: Of the page, the header, and every other row.
COLOURS = [("#ffffff", "#e8e8e8", "#f7f7f7"), ("#fffdf5", "#f3e2b3", "#fbf4dd"), ("#f5f9ff", "#b9d3f2", "#e3eefb"), ("#f7fff7", "#bfe3c0", "#e6f5e6")]
LINES = ["td, th { border: 1px solid #888888; }", "td, th { border-bottom: 1px solid #bbbbbb; }", "table { border-top: 2px solid #222222; border-bottom: 2px solid #222222; }"]


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))


def style_sheet(style: Column) -> Column:
    """The style sheet of a style: the number's rest by the fonts, then by the colours, then by the lines."""
    font, colour, line = style, F.floor(style / len(FONTS)), F.floor(style / (len(FONTS) * len(COLOURS)))
    page, head, row = (_pick([c[k] for c in COLOURS], colour) for k in range(3))
    rules = [F.lit("body { background: "), page, F.lit("; font-family: "), _pick(FONTS, font), F.lit("; } table { border-collapse: collapse; } td, th { padding: 4px 8px; } th { background: "), head, F.lit("; } tr:nth-child(even) { background: "), row, F.lit("; } "), _pick(LINES, line)]
    return F.concat(*rules)


def page(columns: Column, data: Column, style: Column) -> Column:
    """A whole page: the table in its style."""
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><style>'), style_sheet(style), F.lit("</style></head><body>"), html(columns, data), F.lit("</body></html>"))


def _draw(key: Column, name: str) -> Column:
    """A number from 0 to 1 that the key and the name decide."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 12), 16, 10).cast("double") / float(16**12)


def style_of(key: Column) -> Column:
    return F.floor(_draw(key, "style") * STYLES).cast("int")


def render_worklist(tables: DataFrame, noisy: int = 3) -> DataFrame:
    """One clean image and some noisy ones of each (table_id, lang), named <lang>_clean and <lang>_noise<n>."""
    kinds = F.explode(F.array(F.lit("clean"), *(F.lit(f"noise{i}") for i in range(1, noisy + 1))))
    out = tables.select("table_id", "lang", kinds.alias("kind")).withColumn("image_filename", F.concat("lang", F.lit("_"), "kind", F.lit(".jpg")))
    return out.withColumn("style", style_of(F.concat_ws("/", "table_id", "image_filename")))


def noise_plan(images: DataFrame) -> DataFrame:
    """Parameters and stages of each noisy image, drawn from its name: the same on every run."""
    key = F.concat_ws("/", "table_id", "image_filename")
    real = [F.round(F.lit(float(a)) + _draw(key, n) * (b - a), 6).alias(n) for n, (a, b) in REAL.items()]
    whole = [(F.lit(a) + F.floor(_draw(key, n) * (b - a + 1))).cast("int").alias(n) for n, (a, b) in WHOLE.items()]
    stages = F.array_join(F.array_compact(F.array(*(F.when(_draw(key, f"stage {n}") < p, n) for n, p in STAGES.items()))), ">")
    return images.where("kind <> 'clean'").select("table_id", "image_filename", *real, *whole, stages.alias("stages"))
