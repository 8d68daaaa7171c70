"""Which points of a sweep are finished: identities of configs and runs, layer aliases, the pending grid."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that runs get when they are evaluated, and the layers of the two families of backbones.
RUNTIME_TAGS = ("set_name", "severity", "scorer_result", "validity")
CNN_LAYERS, CNN_DEFAULT, CNN_WIDER, VIT_DEFAULT = ("layer1", "layer2", "layer3", "layer4"), ("layer2", "layer3"), ("layer4", "layer1"), (-1,)
ADDITIONAL = {"one_additional": 1, "two_additional": 2}
VIT_PREFIXES = ("dinov2_", "dinov3_")


def is_vit(backbone: str) -> bool:
    return backbone.startswith(VIT_PREFIXES)


def resolve_layers(backbone: str, layers: str | Sequence | None) -> list:
    """Layers of a backbone: its family's default, the default and so many more, or those listed (which must be of its family)."""
    more = 0 if layers is None or layers == "default" else ADDITIONAL.get(layers) if isinstance(layers, str) else -1
    if more is None:
        raise ValueError(f"layers must be a list, default or one of {sorted(ADDITIONAL)}, not {layers!r}")
    if more < 0:
        wrong = [] if is_vit(backbone) else [x for x in layers if x not in CNN_LAYERS]
        if wrong:
            raise ValueError(f"{backbone} has no layers {wrong}, only {list(CNN_LAYERS)}")
        return list(layers)
    if is_vit(backbone):
        return list(range(min(VIT_DEFAULT) - more, 0))
    return sorted({*CNN_DEFAULT, *CNN_WIDER[:more]})


def as_logged(configs: DataFrame, backbone: str = "backbone", layers: str = "layers", params: str = "params") -> DataFrame:
    """configs whose layer aliases in params are written as their runs log them. Aliases are looked up, so any number of configs takes one pass."""
    name, alias = F.col(params)[backbone], F.coalesce(F.col(params)[layers], F.lit("default"))
    told = [(v, a, str(resolve_layers(v + "x" if v else "", a))) for v in (VIT_PREFIXES[0], "") for a in ("default", *ADDITIONAL)]
    vit = F.rlike(name, F.lit("^(" + "|".join(map(re.escape, VIT_PREFIXES)) + ")"))
    written = F.coalesce(*[F.when((vit if v else ~vit) & (alias == a), F.lit(text)) for v, a, text in told], F.col(params)[layers])
    changed = F.map_concat(F.map_filter(params, lambda k, _: k != layers), F.map_from_arrays(F.array(F.lit(layers)), F.array(written)))
    return configs.withColumn(params, F.when(name.isNotNull() & F.map_contains_key(params, layers), changed).otherwise(F.col(params)))


def declared_tags(configs: DataFrame, tags: str = "tags") -> list[str]:
    """Names of the configs' tags that tell sweep points apart: those that runs get later don't."""
    names = configs.select(F.explode(F.map_keys(tags)).alias("name")).distinct().collect()  # a handful of names
    return sorted(r["name"] for r in names if r["name"] not in RUNTIME_TAGS)


def identity(tag_names: Sequence[str], tags: str = "tags", params: str = "params") -> Column:
    """What tells a sweep point apart: its declared tags and all of its parameters, sorted, those without a value left out."""
    kept = lambda c, test: F.array_sort(F.map_entries(F.map_filter(c, test)))
    return F.struct(kept(tags, lambda k, v: v.isNotNull() & k.isin(*tag_names)).alias("tags"), kept(params, lambda k, v: v.isNotNull()).alias("params"))


def expected_sets(synthetic: Column, real: Column | None = None) -> Column:
    """The sets a config is evaluated on: the real one, unless it is switched off, and the synthetic ones."""
    wanted = F.lit(True) if real is None else F.coalesce(real, F.lit(True))
    return F.concat(F.when(wanted, F.array(F.lit("real"))).otherwise(F.array().cast("array<string>")), F.coalesce(synthetic, F.array().cast("array<string>")))


def fetch_runs(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """Runs in any state that may belong to the grid: of its versions and experiments, where it names any."""
    found = runs
    for name, own in (("version", F.col("tags")["version"]), ("experiment", F.col("experiment") if "experiment" in runs.columns else None)):
        source = F.col("tags")["version"] if name == "version" else (F.col("experiment") if "experiment" in configs.columns else None)
        if own is None or source is None:
            continue
        wanted = configs.select(source.alias("__wanted")).where("__wanted IS NOT NULL").distinct()
        if not wanted.isEmpty():
            found = found.withColumn("__own", own).join(wanted, F.col("__own") == F.col("__wanted"), "left_semi").drop("__own")
    return found


def partition_grid(configs: DataFrame, runs: DataFrame, tag_names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(configs with complete, stale runs) of a grid (grid_pos, tags, params, expected).

    A config is complete when each expected set has a finished run; what is stale are its failed runs. Of an incomplete config all runs are stale, as a
    rerun writes every arm again. Runs still running are neither."""
    names = declared_tags(configs) if tag_names is None else list(tag_names)
    grid = as_logged(configs).select("grid_pos", "expected", F.to_json(identity(names)).alias("__id"))
    logged = runs.select(F.to_json(identity(names)).alias("__id"), "run_id", "status", F.col("tags")["set_name"].alias("set_name")).where("set_name IS NOT NULL")
    finished = logged.where("status = 'FINISHED'").groupBy("__id").agg(F.collect_set("set_name").alias("finished"))
    nothing = F.array().cast("array<string>")
    grid = grid.join(finished, "__id", "left").withColumn("complete", F.size(F.array_except("expected", F.coalesce("finished", nothing))) == 0)
    stale = grid.join(logged, "__id").where("status <> 'RUNNING' AND NOT (complete AND status = 'FINISHED')").select("grid_pos", "run_id", "status", "set_name")
    return configs.join(grid.select("grid_pos", "complete"), "grid_pos"), stale


def filter_completed_configs(configs: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(configs left to run, in grid order; runs to delete)."""
    told, stale = partition_grid(configs, fetch_runs(runs, configs))
    return told.where("NOT complete").drop("complete").orderBy("grid_pos"), stale


def feature_key(configs: DataFrame, columns: Sequence[str], data: Mapping[str, str] | Sequence[str] = ()) -> DataFrame:
    """Adds feature_key: configs of equal key share extracted features. Listed columns as they are, data settings as JSON with sorted names."""
    settings = F.to_json(F.struct(*[F.col(c) for c in sorted(data)]), {"ignoreNullFields": "false"}) if data else F.lit("{}")
    return configs.withColumn("feature_key", F.to_json(F.struct(*[F.col(c) for c in columns], settings.alias("datasets")), {"ignoreNullFields": "false"}))
