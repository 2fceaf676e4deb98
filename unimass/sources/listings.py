"""Image folders as tables: listing, class filters, whitelists, spatial and token pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unimass.operators.ordering import global_order
from unimass.session import materialize

BASENAME = r"([^/]+)$"


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, category, category_idx) of <root>/<class>/<file>; classes in sorted order.

    Only paths are read, never the contents, and the folders are listed once: what follows reads
    the list.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    paths = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"))
    return index_classes(materialize(paths, "paths"))


def write_files(files: DataFrame, root: str) -> None:
    """Write the lines of every row of (path, lines) to the file <root>/<path>.

    For many small files of given names: the tasks write them in place, where a partitioned write
    makes a folder for every file and moves each one when it commits. A repeated task writes the
    same files again.
    """
    def write(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for row in rows:
            target = f"{base}/{row.path}"
            parent = target.rsplit("/", 1)[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(target) as out:
                out.write("".join(f"{line}\n" for line in row.lines).encode())

    files.select("path", "lines").foreachPartition(write)


def index_classes(images: DataFrame) -> DataFrame:
    """Add category_idx: place of the class among the sorted classes (a short list)."""
    order = images.select("category").distinct()
    idx = (F.row_number().over(Window.orderBy("category")) - 1).alias("category_idx")
    return images.join(order.select("category", idx), "category")


def filter_classes(images: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
    """Keep the requested classes; category_idx is the requested order without duplicates."""
    wanted = list(dict.fromkeys(names))
    have = {r["category"] for r in images.select("category").distinct()
            .filter(F.col("category").isin(wanted)).collect()}
    missing = [n for n in wanted if n not in have]
    if missing and strict:
        raise ValueError(f"requested classes not found: {missing}")
    kept = [n for n in wanted if n in have]
    if not kept:
        raise ValueError("none of the requested classes exists")
    place = F.array_position(F.array(*[F.lit(k) for k in kept]), F.col("category")) - 1
    return images.filter(F.col("category").isin(kept)).withColumn("category_idx", place.cast("int"))


def filter_first_n_classes(images: DataFrame, n: int) -> DataFrame:
    """Images of the first n classes in sorted order."""
    return images.filter(F.col("category_idx") < n)


def limit_per_class(images: DataFrame, n: int) -> DataFrame:
    """First n images of each class in path order."""
    # a rank that is only compared with n lets each task keep n rows of a class
    place = F.row_number().over(Window.partitionBy("category").orderBy("path"))
    return images.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def filter_whitelist(images: DataFrame, whitelist: DataFrame, per_class: int | None = None,
                     basename: bool = True, strict: bool = False) -> DataFrame:
    """Keep whitelisted files per class.

    `whitelist` is (category, name, ordinal) in list order; per_class keeps the first names of
    each list. strict: unknown classes and classes left empty raise.
    """
    names = whitelist
    if per_class is not None:
        first = F.row_number().over(Window.partitionBy("category").orderBy("ordinal"))
        names = names.withColumn("_r", first).filter(F.col("_r") <= per_class).drop("_r")
    part = lambda c: F.regexp_extract(c, BASENAME, 1) if basename else F.col(c)
    keep = names.select("category", part("name").alias("_name")).distinct()
    out = images.withColumn("_name", part("path")).join(keep, ["category", "_name"], "left_semi").drop("_name")
    if strict:
        classes = images.select("category").distinct()
        asked = whitelist.select("category").distinct()
        unknown = [r[0] for r in asked.join(classes, "category", "left_anti").limit(20).collect()]
        if unknown:
            raise ValueError(f"unknown classes in the whitelist: {unknown}")
        empty = [r[0] for r in asked.join(out.select("category").distinct(), "category", "left_anti").limit(20).collect()]
        if empty:
            raise ValueError(f"no images kept for classes {empty}")
    return out


def pool_spatial(maps: DataFrame, mode: str = "mean") -> DataFrame:
    """Per image and channel: mean, max or L2 norm over positions of (y, x, act)."""
    agg = {"mean": F.avg("act"), "max": F.max("act"), "l2": F.sqrt(F.sum(F.col("act") * F.col("act")))}
    if mode not in agg:
        raise ValueError(f"mode must be one of {sorted(agg)}, got {mode!r}")
    return maps.groupBy("image_id", "channel").agg(agg[mode].alias("act"))


def reduce_tokens(tokens: DataFrame, mode: str = "cls") -> DataFrame:
    """Per image and unit: the class token, the mean of all tokens, or of the patch tokens."""
    if mode == "cls":
        return tokens.filter(F.col("token") == 0).select("image_id", "unit_id", "act")
    if mode not in ("mean", "patch_mean"):
        raise ValueError(f"mode must be 'cls', 'mean' or 'patch_mean', got {mode!r}")
    rows = tokens.filter(F.col("token") >= 1) if mode == "patch_mean" else tokens
    return rows.groupBy("image_id", "unit_id").agg(F.avg("act").alias("act"))


# Architectures with their layer counts, diets, and diet labels whose model
# suffix depends on the architecture.
ARCHS = {
    "alexnet": [("conv", 1, 5), ("fc", 6, 7)],
    "alexnet-barlow-twins": [("conv", 1, 5), ("fc", 6, 7)],
    "vgg16": [("conv", 1, 13), ("fc", 14, 15)],
    "resnet50": [("conv", 1, 49)],
}
DIETS = ("ecoset", "imagenet")
DIET_ARCHS = ("alexnet", "vgg16", "resnet50")
DIET_SUFFIX = {
    "ImageNet": {"": "imagenet"},
    "Ecoset": {"": "ecoset"},
    "VGGFace2": {"alexnet": "faces", "vgg16": "faces", "resnet50": "vggface2"},
    "Face-obfuscated": {"": "imagenet-face-obfus"},
}


def _layers(arch: str) -> list[str]:
    return [f"{kind}{i}" for kind, a, b in ARCHS[arch] for i in range(a, b + 1)]


def dim_models(spark: SparkSession, diets=(*DIETS, "untrained"), archs=None) -> DataFrame:
    """(model, arch, diet, layer, layer_ord), architecture by diet."""
    archs = list(ARCHS) if archs is None else archs
    rows = [(f"{a}_{d}", a, d, layer, i)
            for a in archs for d in diets for i, layer in enumerate(_layers(a))]
    return spark.createDataFrame(rows, "model string, arch string, diet string, layer string, layer_ord int")


def dim_diets(spark: SparkSession, archs=DIET_ARCHS) -> DataFrame:
    """(diet label, position, model, layer, layer_ord) of the matched diet contrast."""
    rows = [(label, p, f"{a}_{spec.get(a) or spec['']}", layer, i)
            for label, spec in DIET_SUFFIX.items() for p, a in enumerate(archs)
            for i, layer in enumerate(_layers(a))]
    return spark.createDataFrame(rows, "diet string, position int, model string, layer string, layer_ord int")
