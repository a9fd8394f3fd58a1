"""Annotation files as tables: two XML flavours, and annotation layers."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidejobs.functions.storage import small

def read_files(spark, folder: str) -> DataFrame:
    """path, content (text) of the .xml files in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("content").cast("string").alias("content"))


def list_files(spark, folder: str, extensions: tuple[str, ...] = ("svs", "xml")) -> DataFrame:
    """path of the files in a folder with these extensions; contents aren't read, empty files are passed over. slide_inventory matches slides and annotations among them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").option("recursiveFileLookup", "true").load(folder)
    return found.select("path")


def _elements(content: str) -> tuple[str, list[tuple]]:
    """Flavour and vertices (layer, region, seq, x, y; as written) of a document, or why it has none.

    A child Annotation of the root makes it 'imagescope': each Region within is a region, each Vertex within that a vertex. Else Coordinates anywhere
    make it 'asap': each is a region, its children are vertices. The root's own name plays no part. Regions are numbered 0.. in document order.
    """
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return ("malformed" if content.strip() else "empty"), []
    notes = root.findall("Annotation")
    if notes:
        regions = [(note.get("Id"), list(r.iter("Vertex"))) for note in notes for r in note.iter("Region")]
        return "imagescope", [(layer, i, j, v.get("X"), v.get("Y")) for i, (layer, points) in enumerate(regions) for j, v in enumerate(points)]
    regions = list(root.iter("Coordinates"))
    if not regions:
        return "no annotations", []
    return "asap", [(None, i, j, v.get("X"), v.get("Y")) for i, r in enumerate(regions) for j, v in enumerate(r)]


def elements(files: DataFrame) -> DataFrame:
    """path, kind (a flavour, or why a file has no annotations), layer, region, seq, x, y as they are written; a file without vertices has one row of nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(*[c.to_pylist() for c in b.columns], strict=True):
                kind, found = _elements(content)
                rows = [(path, kind, *f) for f in found or [(None,) * 5]]
                for i in range(0, len(rows), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 100_000], strict=True), types, strict=True)], names)

    names = ["path", "kind", "layer", "region", "seq", "x", "y"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    text = files.select(F.col("path").cast("string").alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    return text.mapInArrow(run, "path string, kind string, layer string, region int, seq int, x string, y string")


def _imagescope(rows: DataFrame, level: int) -> DataFrame:
    number = lambda c: F.expr(f"try_cast({c} as double)")
    read = rows.filter("kind = 'imagescope' and region is not null").withColumns({"x": number("x"), "y": number("y")})
    whole = read.filter(f"abs(x) < {2.0**31} and abs(y) < {2.0**31}")  # neither is null, infinite or no number
    return whole.select("path", F.expr("try_cast(layer as int)").alias("layer_id"), "region", "seq", *[(F.col(c) / (1 << level)).cast("int").alias(c) for c in "xy"])


def _asap(rows: DataFrame, level: int) -> DataFrame:
    read = rows.filter("kind = 'asap' and region is not null")
    bad = lambda c: F.raise_error(F.concat(F.lit(f"a vertex without {c} in "), "path")).cast("int")
    return read.select("path", "region", "seq", *[F.coalesce((F.col(c).cast("double") / (1 << level)).cast("int"), bad(c)).alias(c) for c in "xy"])


def read_imagescope(files: DataFrame, level: int = 0) -> DataFrame:
    """path, layer_id, region, seq, x, y. A vertex that can't be read is left out, its region keeps its number.

    Files whose root has an Annotation child; numbers are divided by 2 ** level and cut towards zero.
    """
    return _imagescope(elements(files), level)


def read_asap(files: DataFrame, level: int = 0) -> DataFrame:
    """path, region, seq, x, y of files whose regions are Coordinates elements. A value that can't be read is an error."""
    return _asap(elements(files), level)


def read_annotations(files: DataFrame, level: int = 0) -> DataFrame:
    """path, flavour, layer_id (null where the flavour has no layers), region, seq, x, y of files of both flavours; rejected_annotations names the rest."""
    rows = elements(files)
    layered = _imagescope(rows, level).withColumn("flavour", F.lit("imagescope"))
    plain = _asap(rows, level).withColumns({"flavour": F.lit("asap"), "layer_id": F.lit(None).cast("int")})
    return layered.unionByName(plain).select("path", "flavour", "layer_id", "region", "seq", "x", "y")


def rejected_annotations(files: DataFrame) -> DataFrame:
    """path, reason of files that hold no annotations: 'empty', 'malformed', or 'no annotations' for a document of another kind."""
    return elements(files).filter("kind not in ('imagescope', 'asap')").select("path", F.col("kind").alias("reason"))


def annotation_layers(vertices: DataFrame, layers: DataFrame) -> DataFrame:
    """Vertices of the layers that have a class; layers (layer_id, class) with class 'skip' are left out."""
    return vertices.join(small(layers.filter("class <> 'skip'")), "layer_id")


def missing_layers(files: DataFrame, vertices: DataFrame, layers: DataFrame) -> DataFrame:
    """path, layer_id, class of wanted layers that a file lacks. layers has a few rows."""
    wanted = files.select("path").distinct().crossJoin(small(layers.filter("class <> 'skip'")))
    return wanted.join(vertices.select("path", "layer_id").distinct(), ["path", "layer_id"], "left_anti")
