"""JSON documents as nodes, and their checks against a table of what each place may hold.

Spark's own JSON readers keep one of several equal keys, and VARIANT refuses them without telling which; here each key
of a document is a node, so that what a strict contract asks for can be seen. A node has the place of its parent, its
path (``$.a[0].b``) and its pattern (``$.a[*].b``). Checks are a relation on patterns: nodes join the table of rules,
and every node that breaks its rule is a row with a code and a path, all failures of a document in one pass.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sources.fields import selector_steps

NODES = T.ArrayType(
    T.StructType(
        [
            T.StructField("at", T.IntegerType()),
            T.StructField("parent", T.IntegerType()),
            T.StructField("depth", T.IntegerType()),
            T.StructField("key", T.StringType()),
            T.StructField("path", T.StringType()),
            T.StructField("pattern", T.StringType()),
            T.StructField("kind", T.StringType()),  # object, array, text, integer, number, boolean, null
            T.StructField("text", T.StringType()),  # of scalars; of arrays of texts their JSON
            T.StructField("keys", T.ArrayType(T.StringType())),  # of objects, as written, repeated ones too
            T.StructField("size", T.IntegerType()),
        ]
    )
)


class _Pairs(list):
    """The members of an object as they stand."""


def _kind(value: object) -> str:
    if isinstance(value, _Pairs):
        return "object"
    names = {list: "array", str: "text", bool: "boolean", int: "integer", float: "number", type(None): "null"}
    return names[type(value)]


def _refused(_: str) -> None:
    raise ValueError("no JSON number")


def _nodes_of(text: str) -> list[dict] | None:
    try:
        found = json.loads(text, object_pairs_hook=_Pairs, parse_constant=_refused)
        if "\\u" in text:
            json.dumps(found, ensure_ascii=False).encode()  # no half of a pair of surrogates
    except (ValueError, RecursionError):
        return None
    out: list[dict] = []
    todo = [(found, None, None, "$", "$", 0)]
    while todo:
        value, parent, key, path, pattern, depth = todo.pop()
        kind, at = _kind(value), len(out)
        told = None
        if kind == "array" and value and all(type(x) is str for x in value):
            told = json.dumps(value, ensure_ascii=False)
        elif kind not in ("object", "array", "null"):
            told = value if kind == "text" else json.dumps(value) if kind != "number" or math.isfinite(value) else "inf"
        node = {"at": at, "parent": parent, "depth": depth, "key": key, "path": path, "pattern": pattern, "kind": kind, "text": told}
        out.append(node | {"keys": [k for k, _ in value] if kind == "object" else None, "size": len(value) if kind in ("object", "array", "text") else None})
        below = []
        if kind == "object":
            below = [(v, at, k, f"{path}.{k}", f"{pattern}.{k}", depth + 1) for k, v in value]
        elif kind == "array":
            below = [(v, at, None, f"{path}[{i}]", f"{pattern}[*]", depth + 1) for i, v in enumerate(value)]
        todo += reversed(below)
    return out


#: Documents, and characters of them, whose nodes Python holds at once.
READ_ROWS, READ_CHARS = 64, 1 << 18
_TEXTS = ("key", "path", "pattern", "kind", "text")
_NODES_ARROW = pa.list_(pa.struct([(n, pa.string() if n in _TEXTS else pa.list_(pa.string()) if n == "keys" else pa.int32()) for n in NODES.elementType.names]))


def _cut(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of at most ``READ_ROWS`` rows and ``READ_CHARS`` characters, one row at least."""
    low, held = 0, 0
    for at, size in enumerate(sizes):
        if at > low and (at - low >= READ_ROWS or held + size > READ_CHARS):
            yield low, at
            low, held = at, 0
        held += size
    if low < len(sizes):
        yield low, len(sizes)


@F.arrow_udf(NODES)
def json_nodes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The nodes of a JSON text in document order; null where it is no JSON. NaN and infinities are none."""
    for batch in texts:
        held = batch.to_pylist()
        for low, high in _cut([len(x or "") for x in held]):
            yield pa.array([None if x is None else _nodes_of(x) for x in held[low:high]], _NODES_ARROW)
        if not held:
            yield pa.array([], _NODES_ARROW)


def duplicate_keys(nodes: Column) -> Column:
    """Paths of objects in which a key stands twice."""
    twice = F.filter(nodes, lambda n: F.size(n.keys) > F.size(F.array_distinct(n.keys)))
    return F.transform(twice, lambda n: n.path)


@dataclass(frozen=True)
class Rule:
    """What may stand at a pattern. ``check`` names the test; a null passes where ``nullable``.

    ``object``: keys are ``required`` and, if not None, at most ``optional`` besides. ``array``: ``least`` to ``most`` entries.
    ``text``: a string of at most ``most`` characters, with a visible one if ``least`` is 1, none of them a control
    character where ``plain``; then ``regex``, failing with ``regex_code``. ``choice``: one of ``choices``, of a string or an array of strings.
    ``integer``, ``number``: from ``least`` to ``most``. ``boolean``, ``date``, ``selector``, ``zone``: as named.
    """

    pattern: str
    check: str
    code: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] | None = ()
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()
    regex: str | None = None
    regex_code: str | None = None
    nullable: bool = False
    plain: bool = False
    key_code: str | None = None


_RULE = "contract string, pattern string, check string, code string, required array<string>, optional array<string>, least double, most double, choices array<string>, regex string, regex_code string, nullable boolean, plain boolean, key_code string"


def rules_table(spark: SparkSession, contracts: dict[str, tuple[Rule, ...]]) -> DataFrame:
    rows = []
    for contract, rules in contracts.items():
        for r in rules:
            optional = None if r.optional is None else list(r.optional)
            bounds = [None if x is None else float(x) for x in (r.least, r.most)]
            rows.append((contract, r.pattern, r.check, r.code, list(r.required), optional, *bounds, list(r.choices), r.regex, r.regex_code, r.nullable, r.plain, r.key_code or r.code))
    return spark.createDataFrame(rows, _RULE)


@F.pandas_udf(T.BooleanType())
def _is_selector(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x is not None and selector_steps(x) is not None)


@F.pandas_udf(T.BooleanType())
def _known_zone(name: pd.Series) -> pd.Series:
    from zoneinfo import ZoneInfo

    def known(x: str | None) -> bool:
        try:
            return x is not None and bool(ZoneInfo(x))
        except (ValueError, OSError, KeyError):
            return False

    return name.map(known)


def broken_rules(documents: DataFrame, contracts: dict[str, tuple[Rule, ...]]) -> DataFrame:
    """``id, code, path`` of ``id, contract, nodes``: each node that breaks the rule of its pattern.

    Patterns without a rule are told by their parent, whose keys they are. Rules are a small table. A column ``told``
    (``code, path`` of each document) passes through in the same reading.
    """
    rules = rules_table(documents.sparkSession, contracts)
    if "told" in documents.columns:
        node = documents.schema["nodes"].dataType.elementType
        none = F.lit(None).cast(node)
        each = F.concat(F.transform("told", lambda f: F.struct(f.code.alias("told"), f.path.alias("path"), none.alias("n"))), F.transform(F.coalesce("nodes", F.array().cast(T.ArrayType(node))), lambda n: F.struct(F.lit(None).cast("string").alias("told"), n.path.alias("path"), n.alias("n"))))
        nodes = documents.select("id", "contract", F.explode(each).alias("x")).select("id", "contract", "x.told", "x.path", "x.n")
    else:
        nodes = documents.select("id", "contract", F.explode("nodes").alias("n")).select("id", "contract", F.lit(None).cast("string").alias("told"), "n.path", "n")
    met = nodes.withColumn("pattern", F.col("n.pattern")).join(F.broadcast(rules), ["contract", "pattern"], "left").where("told is not null or code is not null")
    kind, text = F.col("n.kind"), F.col("n.text")
    number = F.when(kind.isin("integer", "number"), text.cast("double"))
    between = lambda x: (F.col("least").isNull() | (x >= F.col("least"))) & (F.col("most").isNull() | (x <= F.col("most")))
    is_text = (kind == "text") & (F.length(text) <= F.coalesce("most", F.lit(1 << 30))) & ((F.coalesce("least", F.lit(0)) < 1) | text.rlike(r"(?U)\S"))
    is_text = is_text & (~F.col("plain") | ~text.rlike(r"[\x00-\x1F\x7F]"))
    has_keys = F.size(F.array_except("required", "n.keys")) == 0
    known = F.col("optional").isNull() | (F.size(F.array_except("n.keys", F.concat("required", F.coalesce("optional", F.array().cast("array<string>"))))) == 0)
    holds = (
        F.when(F.col("check").isin("object"), kind == "object")
        .when(F.col("check") == "array", (kind == "array") & between(F.col("n.size").cast("double")))
        .when(F.col("check") == "choice", kind.isin("text", "array") & F.array_contains("choices", text))
        .when(F.col("check") == "integer", (kind == "integer") & between(number))
        .when(F.col("check") == "number", number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")) & between(number))
        .when(F.col("check") == "boolean", kind == "boolean")
        .when(F.col("check") == "date", is_text & text.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & (text >= "0001") & F.try_to_date(text).isNotNull())
        .otherwise(is_text)
    )
    special = F.when(F.col("regex").isNotNull(), F.rlike(text, F.col("regex")))
    # what Python has to judge goes there only where a rule asks for it
    checks = {r.check for rules_of in contracts.values() for r in rules_of}
    for check, judge in (("selector", _is_selector), ("zone", _known_zone)):
        if check in checks:
            special = F.when(F.col("check") == check, judge(F.when(F.col("check") == check, text))).otherwise(special)
    holds = F.coalesce(holds, F.lit(False))
    code = (
        F.when(F.col("told").isNotNull(), F.col("told"))
        .when(F.col("nullable") & (kind == "null"), None)
        .when(~holds, F.col("code"))
        .when((F.col("check") == "object") & ~(has_keys & known), F.col("key_code"))
        .when(~F.coalesce(special, F.lit(True)), F.coalesce("regex_code", "code"))
    )
    return met.select("id", code.alias("code"), "path").where("code is not null")
