"""Typed recipes: a hashed chain of operators over one recording span, or over all recordings, that becomes one Spark plan.

``{"recording_id": int or null for all, "span": [start, end] or null, "steps": [{"stage", "algorithm", "params"}]}``. A step's declared input
kind must be what the step before it gives; the chain starts from ``signal``. Nothing runs until the result is read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("signal", "spanset", "windowset", "scores", "encoding", "grouping", "model")


@dataclass(frozen=True)
class Param:
    default: object
    kind: type = float
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def check(self, name: str, value):
        value = None if value is None else self.kind(value)
        if value is not None and ((self.low is not None and value < self.low) or (self.high is not None and value > self.high)):
            raise ValueError(f"{name}={value} is out of range")
        if self.choices and value not in self.choices:
            raise ValueError(f"{name}={value} is none of {self.choices}")
        return value


@dataclass(frozen=True)
class Operator:
    name: str
    stage: str
    run: Callable[..., DataFrame]
    input_kind: str = "signal"
    output_kind: str = "signal"
    params: dict[str, Param] = field(default_factory=dict)
    most_samples: int | None = None

    def validated(self, given: dict) -> dict:
        unknown = sorted(set(given) - set(self.params))
        if unknown:
            raise ValueError(f"{self.name} has no parameter {', '.join(unknown)}")
        return {k: p.check(k, given.get(k, p.default)) for k, p in self.params.items()}


_registry: dict[tuple[str, str], Operator] = {}


def register(op: Operator) -> Operator:
    if (op.stage, op.name) in _registry:
        raise ValueError(f"{op.stage}.{op.name} is registered already")
    if op.input_kind not in KINDS or op.output_kind not in KINDS:
        raise ValueError("unknown kind")
    _registry[op.stage, op.name] = op
    return op


def get(stage: str, name: str) -> Operator:
    if (stage, name) not in _registry:
        raise KeyError(f"no operator {stage}.{name}")
    return _registry[stage, name]


def operators(stage: str | None = None) -> list[Operator]:
    return [op for (s, _), op in sorted(_registry.items()) if stage in (None, s)]


def make(recording_id: int | None, steps: list[dict], span: tuple[int, int] | None = None) -> dict:
    if span is not None and not span[0] < span[1]:
        raise ValueError("a span must increase")
    for step in steps:
        if any(hasattr(v, "__array__") for v in step.get("params", {}).values()):
            raise TypeError("arrays cannot be parameters")
    return {"recording_id": None if recording_id is None else int(recording_id), "span": None if span is None else [int(span[0]), int(span[1])], "steps": [{"stage": s["stage"], "algorithm": s["algorithm"], "params": dict(s.get("params", {}))} for s in steps]}


def canonical(recipe: dict) -> str:
    return json.dumps(recipe, sort_keys=True, separators=(",", ":"))


def full_hash(recipe: dict) -> str:
    return hashlib.sha256(canonical(recipe).encode()).hexdigest()


def short_hash(recipe: dict) -> str:
    return full_hash(recipe)[:8]


def summary(recipe: dict) -> str:
    return " > ".join(f"{s['stage']}.{s['algorithm']}" for s in recipe["steps"])


def problems(recipe: dict) -> list[str]:
    """What is wrong with the chain; checking stops at an unknown operator."""
    kind, out = "signal", []
    for k, s in enumerate(recipe["steps"]):
        try:
            op = get(s["stage"], s["algorithm"])
        except KeyError as e:
            return [*out, f"step {k}: {e.args[0]}"]
        if op.input_kind != kind:
            out.append(f"step {k}: {op.name} takes {op.input_kind}, not {kind}")
        try:
            op.validated(s["params"])
        except (ValueError, TypeError) as e:
            out.append(f"step {k}: {e}")
        kind = op.output_kind
    return out


def compile_plan(recipe: dict, signal: DataFrame, held_out: frozenset[int] = frozenset(), unlocked: bool = False) -> DataFrame:
    """The recipe's DataFrame over ``signal``; indices stay those of the channel, not of the span. One over all recordings would read held-out ones too."""
    if recipe["recording_id"] is None and held_out and not unlocked:
        raise PermissionError(f"{len(held_out)} recordings are held out")
    if recipe["recording_id"] in held_out and not unlocked:
        raise PermissionError(f"recording {recipe['recording_id']} is held out")
    wrong = problems(recipe)
    if wrong:
        raise ValueError("; ".join(wrong))
    df = signal if recipe["recording_id"] is None else signal.filter(F.col("recording_id") == recipe["recording_id"])
    if recipe["span"]:
        df = df.filter((F.col("idx") >= recipe["span"][0]) & (F.col("idx") < recipe["span"][1]))
        width = recipe["span"][1] - recipe["span"][0]
    else:
        width = None
    for s in recipe["steps"]:
        op = get(s["stage"], s["algorithm"])
        if op.most_samples is not None and width is not None and width > op.most_samples:
            raise ValueError(f"{op.name} takes at most {op.most_samples} samples")
        df = op.run(df, **op.validated(s["params"]))
    return df


class Runs:
    """Completed results by (recipe, data) hash in a folder of Parquet tables: a recipe runs once, later calls read."""

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, recipe: dict, data_hash: str) -> str:
        return f"{self.folder}/{short_hash(recipe)}-{hashlib.sha256((full_hash(recipe) + data_hash).encode()).hexdigest()[:16]}"

    def done(self, recipe: dict, data_hash: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(recipe, data_hash) + "/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def run(self, recipe: dict, signal: DataFrame, data_hash: str, force: bool = False, held_out: frozenset[int] = frozenset(), unlocked: bool = False) -> DataFrame:
        """The recipe's result, computed unless it is there; a held-out recording is refused even where its result is."""
        plan = compile_plan(recipe, signal, held_out, unlocked)
        if force or not self.done(recipe, data_hash):
            plan.write.mode("overwrite").parquet(self.path(recipe, data_hash))
        return self.spark.read.parquet(self.path(recipe, data_hash))


def content_hash(signal: DataFrame) -> DataFrame:
    """``recording_id, content``: the same for the same values in any row order; a row given twice counts twice.

    Two hashes are summed modulo a power of two beside the count, so equal rows do not cancel and nothing overflows.
    """
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "idx", "x"), F.lit(1 << 31)))
    return signal.groupBy("recording_id").agg(F.concat_ws("-", F.hex(part(1)), F.hex(part(2)), F.count("*")).alias("content"))


def tier(seconds: float | None) -> str | None:
    """Where work of an estimated length belongs: up to 60 s interactive, up to 900 s background, else cluster; unknown stays unknown."""
    return None if seconds is None else "interactive" if seconds <= 60 else "background" if seconds <= 900 else "cluster"
