"""Files of code repositories as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import content_hash, dhash, header_size, popcount, svg_stats
from ..functions.names import IMAGE_EXTENSIONS, category, path_extension, stem
from ..functions.util import basename, dirname
from ..operators.incremental import dense_ids, index_run, require_root
from ..operators.styles import style_files
from ..operators.text import in_size
from ..session import cut, new_folder

# Text files searched for references.
CODE_EXTENSIONS = [
    "ts", "tsx", "js", "jsx", "mjs", "cjs", "vue", "svelte", "astro", "html", "htm", "css", "scss",
    "sass", "less", "styl", "json", "md", "mdx", "yml", "yaml",
]
#: raster formats Spark's image source decodes
DECODABLE = ["png", "jpg", "jpeg", "gif"]
DEFAULT_IGNORE = [r"(?:^|/)node_modules/", r"(?:^|/)\.[^/]+"]
#: files a reader is given by name at a time
FILES_AT_ONCE = 10_000
RASTER = {
    "width": "int", "height": "int", "dominant_color": "string", "phash": "string",
    "phash_popcount": "int", "white_fraction": "double",
}


def local_path(path: Column) -> Column:
    """Path without the file-system scheme Spark puts in front of it."""
    return F.regexp_replace(path, r"^file:(?://)?(?=/)", "")


def any_case(extensions: list[str]) -> str:
    """Glob of file names with one of the extensions, in any letter case."""

    def both(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "*.{" + ",".join(both(e) for e in extensions) + "}"


def read_binary(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """All files below ``root`` with one of the extensions, in any letter case."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", any_case(extensions))
        .load(root)
    )


def with_path_parts(files: DataFrame, root: str, source_id: int, ignore: list[str]) -> DataFrame:
    """abs/rel path, dir, name, stem and ext; dotfiles and ignored paths are dropped."""
    base = root.rstrip("/") + "/"
    abs_path = local_path(F.col("path"))
    rel = F.when(abs_path.startswith(base), F.substring(abs_path, len(base) + 1, 1 << 20)).otherwise(
        abs_path
    )
    parts = (
        files.withColumn("source_id", F.lit(source_id).cast("long"))
        .withColumn("abs_path", abs_path)
        .withColumn("rel_path", rel)
    )
    for pattern in ignore:
        parts = parts.filter(~F.col("rel_path").rlike(pattern))
    return (
        parts.withColumn("dir", dirname(F.col("rel_path")))
        .withColumn("name", basename(F.col("rel_path")))
        .withColumn("stem", stem(F.col("name")))
        .withColumn("ext", path_extension(F.col("name")))
    )


def scan_assets(
    spark: SparkSession,
    root: str,
    source_id: int,
    extensions: list[str] | None = None,
    ignore: list[str] | None = None,
) -> DataFrame:
    """Image files with path parts, size, mtime in ms and content."""
    files = read_binary(spark, root, extensions or IMAGE_EXTENSIONS)
    parts = with_path_parts(files, root, source_id, DEFAULT_IGNORE if ignore is None else ignore)
    return parts.select(
        "source_id", "abs_path", "rel_path", "dir", "name", "stem", "ext",
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime"),
        "content",
    )


def list_assets(
    spark: SparkSession,
    root: str,
    source_id: int,
    extensions: list[str] | None = None,
    ignore: list[str] | None = None,
) -> DataFrame:
    """Image files with path parts, size and mtime; no file is opened."""
    files = read_binary(spark, root, extensions or IMAGE_EXTENSIONS).drop("content")
    parts = with_path_parts(files, root, source_id, DEFAULT_IGNORE if ignore is None else ignore)
    return parts.select(
        "source_id", "abs_path", "rel_path", "dir", "name", "stem", "ext", F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime"), F.col("path").alias("uri"),
    )


def scan_code(
    spark: SparkSession,
    root: str,
    source_id: int,
    extensions: list[str] | None = None,
    ignore: list[str] | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Text files for the reference scan, without empty ones and those over ``max_chars`` if given."""
    files = read_binary(spark, root, extensions or CODE_EXTENSIONS)
    parts = with_path_parts(files, root, source_id, DEFAULT_IGNORE if ignore is None else ignore)
    raw = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    text = F.decode(F.col("content"), "UTF-8")
    return (
        parts.select("source_id", "rel_path", "abs_path", raw.alias("ext"), text.alias("text"))
        .filter(in_size(max_chars))
    )


def scan_style_files(spark: SparkSession, root: str, source_id: int) -> DataFrame:
    return style_files(scan_code(spark, root, source_id))


IMAGE_FEATURES = (
    "origin string, width int, height int, dominant_color string, grid array<int>, "
    "white_fraction double"
)


def _shrink(channel: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Area average of a channel on a rows x cols grid."""
    h, w = channel.shape
    top = np.linspace(0, h, rows + 1)
    left = np.linspace(0, w, cols + 1)
    cum = np.zeros((h + 1, w + 1))
    cum[1:, 1:] = channel.cumsum(0).cumsum(1)

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        a, b = cum[np.ix_(y0, x0)], cum[np.ix_(y0, x0 + 1)]
        c, d = cum[np.ix_(y0 + 1, x0)], cum[np.ix_(y0 + 1, x0 + 1)]
        return a * (1 - fy) * (1 - fx) + b * (1 - fy) * fx + c * fy * (1 - fx) + d * fy * fx

    sums = at(top, left)
    area = np.outer(np.diff(top), np.diff(left))
    return (sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]) / area


def _pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Decoded BGR(A) bytes to RGB floats on a white ground."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    if channels == 1:
        return np.repeat(raw, 3, axis=2)
    rgb = raw[:, :, 2::-1]
    if channels == 4:
        alpha = raw[:, :, 3:] / 255.0
        rgb = rgb * alpha + 255.0 * (1 - alpha)
    return rgb


def _grey_grid(rgb: np.ndarray) -> list[int]:
    """9x8 grey grid of the picture fitted inside the grid on white."""
    grey = rgb @ np.array([0.2126, 0.7152, 0.0722])
    h, w = grey.shape
    scale = min(9 / w, 8 / h)
    cols, rows = max(1, round(w * scale)), max(1, round(h * scale))
    grid = np.full((8, 9), 255.0)
    y, x = (8 - rows) // 2, (9 - cols) // 2
    grid[y : y + rows, x : x + cols] = _shrink(grey, rows, cols)
    return [int(v) for v in np.rint(grid).ravel()]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for origin, h, w, c, data in batch.itertuples(index=False):
            if h <= 0 or w <= 0:
                out.append((origin, None, None, None, None, None))
                continue
            rgb = _pixels(data, h, w, c)
            mean = [int(v) for v in np.rint(rgb.mean(axis=(0, 1)))]
            white = float((rgb >= 250).all(axis=2).mean())
            out.append((origin, w, h, "#{:02x}{:02x}{:02x}".format(*mean), _grey_grid(rgb), white))
        yield pd.DataFrame(
            out, columns=["origin", "width", "height", "dominant_color", "grid", "white_fraction"]
        )


def raster_features(images: DataFrame) -> DataFrame:
    """Dimensions, mean colour, fingerprint and white share from Spark's ``image`` rows.

    Spark decodes; the per-batch NumPy part only averages pixels. An undecodable file keeps its row
    with nulls.
    """
    rows = images.select(
        "image.origin", "image.height", "image.width", "image.nChannels", "image.data"
    )
    found = rows.mapInPandas(_features, IMAGE_FEATURES)
    phash = dhash(F.col("grid"))
    return found.select(
        local_path(F.col("origin")).alias("abs_path"),
        "width",
        "height",
        "dominant_color",
        phash.alias("phash"),
        popcount(phash).alias("phash_popcount"),
        "white_fraction",
    )


def read_images(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("image")
        .option("recursiveFileLookup", True)
        .option("dropInvalid", False)
        .option("pathGlobFilter", any_case(DECODABLE))
        .load(root)
    )


def view_size(view_box: Column) -> list[Column]:
    """Width and height of a view box, rounded."""
    box = F.split(F.trim(view_box), r"[\s,]+")

    def side(i: int) -> Column:
        return F.round(F.try_element_at(box, F.lit(i)).try_cast("double")).cast("int")

    return [side(3).alias("svg_width"), side(4).alias("svg_height")]


def svg_features(assets: DataFrame) -> DataFrame:
    """SVG statistics with the drawing's own width and height."""
    stats = svg_stats(F.decode("content", "UTF-8"))
    return (
        assets.filter("ext = 'svg'")
        .select("abs_path", stats.alias("s"))
        .select("abs_path", *view_size(F.col("s.view_box")), "s.*")
    )


def build_assets(spark: SparkSession, root: str, source_id: int) -> DataFrame:
    """Scanned assets with hashes and features, ready for the upsert (no ids yet)."""
    return with_content(scan_assets(spark, root, source_id), read_images(spark, root))


def changed_assets(spark: SparkSession, root: str, source_id: int, uris: DataFrame, at_once: int = FILES_AT_ONCE) -> DataFrame:
    """Complete rows of the files of ``uris`` alone, read ``at_once`` at a time.

    A reader takes its paths from the driver, so these come there in bounded lots; each lot's rows
    are written before the next is fetched.
    """
    folder = new_folder(spark, "changed")
    lot, number = [], 0

    def write() -> None:
        # a reader takes paths for patterns
        named = [re.sub(r"([\[\]{}*?\\])", r"\\\1", u) for u in lot]
        files = spark.read.format("binaryFile").load(named)
        parts = with_path_parts(files, root, source_id, []).select(
            "source_id", "abs_path", "rel_path", "dir", "name", "stem", "ext", F.col("length").alias("size"),
            F.unix_millis("modificationTime").alias("mtime"), "content",
        )
        pictures = [u for u in named if u.rsplit(".", 1)[-1].lower() in DECODABLE]
        images = spark.read.format("image").option("dropInvalid", False).load(pictures) if pictures else None
        with_content(parts, images).write.parquet(f"{folder}/lot={number}")

    for row in uris.select("uri").toLocalIterator():
        lot.append(row["uri"])
        if len(lot) == at_once:
            write()
            lot, number = [], number + 1
    if lot or not number:
        if not lot:
            return with_content(scan_assets(spark, root, source_id).limit(0), None)
        write()
    return spark.read.option("mergeSchema", True).parquet(folder).drop("lot")


def index_source(
    spark: SparkSession, root: str, source_id: int, stored: DataFrame, full: bool = False, most_gone: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """Index a folder against the stored catalogue, opening new and changed files only."""
    require_root(spark, root)
    listing = cut(list_assets(spark, root, source_id))

    def read_changed(paths: DataFrame) -> DataFrame:
        return changed_assets(spark, root, source_id, listing.join(paths, "abs_path"))

    return index_run(listing, stored, read_changed, source_id, full, most_gone)


def with_content(scanned: DataFrame, images: DataFrame | None) -> DataFrame:
    """Hashes and features of scanned files; width and height come from the header where no decoder reads it."""
    hashed = scanned.withColumns({
        "content_hash": content_hash(F.col("content")), "sha1": F.sha1("content"), "header": header_size(F.col("content")),
    })
    if images is None:
        raster = scanned.select("abs_path", *[F.lit(None).cast(t).alias(n) for n, t in RASTER.items()]).limit(0)
    else:
        raster = raster_features(images)
    joined = (
        hashed.drop("content")
        .join(raster, "abs_path", "left")
        .join(svg_features(scanned), "abs_path", "left")
        .withColumn("width", F.coalesce("width", "header.width", "svg_width"))
        .withColumn("height", F.coalesce("height", "header.height", "svg_height"))
        .drop("svg_width", "svg_height", "header")
    )
    return joined.withColumn(
        "category", category(F.col("ext"), F.col("width"), F.col("height"))
    )


def query_signatures(spark: SparkSession, root: str, source_id: int,
                     max_bytes: int | None = None) -> DataFrame:
    """Features of incoming files, as queries against one source; ``refused`` lists those too large."""
    signed = build_assets(spark, root, source_id)
    if max_bytes is not None:
        signed = signed.filter(F.col("size") <= max_bytes)
    return dense_ids(signed, "abs_path", F.lit(0)).withColumnRenamed("asset_id", "query_id")


def refused(assets: DataFrame, max_bytes: int) -> DataFrame:
    """One failure row per incoming file over the size limit."""
    return assets.filter(F.col("size") > max_bytes).select(
        F.lit("query").alias("label"), F.col("rel_path").alias("file"), F.lit("file over the size limit").alias("reason")
    )


def failures(assets: DataFrame) -> DataFrame:
    """One row per raster file without a fingerprint, and one per SVG without text, and why; the run goes on."""
    broken = F.when(F.lower("ext") == "svg", F.col("paths_count").isNull()).otherwise(F.col("phash").isNull())
    return assets.filter(broken).select(
        F.lit("decode").alias("label"),
        F.col("rel_path").alias("file"),
        F.when(F.lower("ext") == "svg", "svg text could not be read")
        .when(F.lower("ext").isin(DECODABLE), "image could not be decoded")
        .otherwise("image format is not decoded")
        .alias("reason"),
    )
