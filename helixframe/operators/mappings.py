"""All mappings by name: payloads to sequences and back, and decoding without knowing the name."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna as D
from ..sources.tables import table
from . import ecc as E
from .ranking import magic
from .repair import container

# Names of mappings in the order in which they are tried; the third to fifth correct errors.
NAMES = ("Simple Mapping", "RINF_B16", "Reed-Solomon", "New Design", "Toolkit RS Baseline")
CORE, COLUMN = 3 * (E.INDEX + E.PAYLOAD + E.PARITY), 120
# Score of any payload, per confidence, and of a container that opens or doesn't.
SOME, CONFIDENCE, VALID, WEAK = 1.0, 10.0, 5.0, -2.0


def _strands(dna: str, size: int) -> list[str]:
    return [dna[i : i + size] for i in range(0, len(dna) - size + 1, size)]


def _reed_solomon(dna: str) -> bytes | None:
    groups: dict[int, dict[int, list[int]]] = {}
    for core in _strands(dna, CORE):
        if (found := E.concatenated_decode_strand(core)) is not None:
            groups.setdefault(found[0], {}).setdefault(found[1], found[2])
    parts = [E.concatenated_recover(groups[g]) for g in sorted(groups)]
    if not parts or sorted(groups) != list(range(len(parts))) or any(p is None for p in parts):
        return None
    raw = bytes(E._regroup(np.concatenate([p.ravel() for p in parts]), 14, 8).astype(np.uint8))
    size = int.from_bytes(raw[:4], "big")
    return raw[4 : 4 + size] if size <= len(raw) - 4 else None


_CODED = {
    "Reed-Solomon": (lambda d: "".join(c for _, _, c in E.concatenated_encode(d)), lambda s, n: _reed_solomon(s)),
    "New Design": (lambda d: "".join(E.block_encode(d)), lambda s, n: (E.block_decode(s) or (None,))[0] if s else b""),
    "Toolkit RS Baseline": (lambda d: "".join(c for _, _, c in E.matrix_encode(d)), lambda s, n: None if n is None else E.matrix_decode(_strands(s, COLUMN), int(n))),
}


def encode(payload: Column, name: Column) -> Column:
    """The sequence of a payload under a mapping's name; null for a name that isn't known."""

    @F.pandas_udf("string")
    def coded(payloads: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or n not in _CODED else _CODED[n][0](bytes(p)) for p, n in zip(payloads, names)], dtype=object)

    native = F.when(name == NAMES[0], D.simple(payload)).when(name == NAMES[1], D.unconstrained(payload))
    return F.coalesce(native, coded(F.when(~name.isin(*NAMES[:2]), payload), name))


def decode(dna: Column, name: Column, size: Column) -> Column:
    """The payload of a sequence under a mapping's name; null where it can't be read. size: the payload's bytes, which the
    last mapping needs (null: not known) and which tell the empty payload of the first two from a byte."""

    @F.pandas_udf("binary")
    def coded(sequences: pd.Series, names: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or n not in _CODED else _CODED[n][1](s, None if pd.isna(k) else k) for s, n, k in zip(sequences, names, sizes)], dtype=object)

    native = F.when(name == NAMES[0], D.unsimple(dna)).when(name == NAMES[1], D.ununconstrained(dna))
    native = F.when(size.isNotNull(), F.substring(native, F.lit(1), size)).otherwise(native)
    return F.coalesce(native, coded(F.when(~name.isin(*NAMES[:2]), dna), name, size))


def each_mapping(df: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    return df.withColumn("mapping", F.explode(F.array(*map(F.lit, names))))


def mapping_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts under every mapping and back."""
    texts = table(spark, sf_dir, "benchmark", spread=True).select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    coded = each_mapping(texts).withColumn("dna", encode(F.col("payload"), F.col("mapping")))
    back = coded.withColumn("decoded", decode(F.col("dna"), F.col("mapping"), F.octet_length("payload")))
    return back.select("item_id", "mapping", F.length("dna").alias("bases"), F.round(F.length("dna") / F.greatest(F.octet_length("payload") * 4, F.lit(1)), 6).alias("bases_a_plain_base"), (F.col("decoded") == F.col("payload")).alias("same"))


def attempts(df: DataFrame, keys: list[str], dna: str, names: tuple[str, ...] = NAMES[:4]) -> DataFrame:
    """keys, mapping, status (Valid, Weak, No magic or Failed), kind, bytes, score, decoded: what each mapping makes of a sequence.

    A mapping without a payload has failed; a payload of a known kind is valid if its container opens. The block code's search is
    long, so it is tried only where no other mapping has a valid payload; elsewhere its row is missing.
    """

    def tried(rows: DataFrame, some: tuple[str, ...]) -> DataFrame:
        made = each_mapping(rows, some).withColumn("decoded", decode(F.col(dna), F.col("mapping"), F.lit(None).cast("int")))
        told = made.withColumn("m", magic(F.col("decoded"))).withColumn("valid", container(F.coalesce("decoded", F.lit("").cast("binary")), F.coalesce("m.kind", F.lit("none")))["valid"])
        known = F.col("m").isNotNull()
        status = F.when(F.col("decoded").isNull(), "Failed").when(~known, "No magic").when(F.col("valid"), "Valid").otherwise("Weak")
        score = F.when(F.col("decoded").isNull(), -1.0).otherwise(
            F.when(F.octet_length("decoded") > 0, SOME).otherwise(0.0) + F.when(known, CONFIDENCE * F.col("m.confidence") + F.when(F.col("valid"), VALID).otherwise(WEAK)).otherwise(0.0)
        )
        return told.select(*keys, "mapping", status.alias("status"), F.col("m.kind").alias("kind"), F.octet_length("decoded").alias("bytes"), score.alias("score"), "decoded")

    fast = tried(df.select(*keys, dna), tuple(n for n in names if n != "New Design"))
    if "New Design" not in names:
        return fast
    done = fast.where("status = 'Valid'").select(*keys).distinct()
    return fast.unionByName(tried(df.select(*keys, dna).join(done, keys, "left_anti"), ("New Design",)))


def best_attempt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each sequence the attempt of the highest score among those whose payload is of a known kind; the first mapping of equals."""
    order = F.array_position(F.array(*map(F.lit, NAMES)), F.col("mapping"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), order))
    return rows.where(F.col("kind").isNotNull()).withColumn("__n", first).where("__n = 1").drop("__n")


def blind_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts under a mapping that their number decides, decoded without its name."""
    keys = ["item_id"]
    texts = table(spark, sf_dir, "benchmark", spread=True).select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    used = F.element_at(F.array(*map(F.lit, NAMES[:3])), (F.col("item_id") % 3 + 1).cast("int"))
    coded = texts.withColumn("used", used).withColumn("dna", encode(F.col("payload"), F.col("used")))
    best = best_attempt(attempts(coded, keys, "dna", NAMES[:3]), keys)
    return coded.join(best, keys, "left").select("item_id", "used", "mapping", "status", "kind", "score", (F.col("decoded") == F.col("payload")).alias("same"))


# Texts are of one kind, opened as they are; a sequence of another mapping has another header, length or strands.
BLIND_SQL = f"""SELECT item_id, {list(NAMES[:3])}[item_id % 3 + 1] AS used, used AS mapping, 'Valid' AS status, 'text' AS kind, {SOME + CONFIDENCE * 0.6 + VALID}::DOUBLE AS score, true AS same FROM benchmark"""

QUERIES = {"mapping_roundtrip": (mapping_roundtrip, None), "blind_attempts": (blind_attempts, BLIND_SQL)}
