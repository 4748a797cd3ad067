"""Field rules on pages: a selector finds a node, and its text, paragraphs or an attribute become the field's value.

Selectors are a small part of CSS: tags, ids, classes and attributes, one below another or a child of another. Each step
is looked up among a page's nodes by its rarest key (id, class or tag), so nodes meet only the steps that may fit them.
The nodes found for the steps of a selector are then joined by containment, in one fold over document order that keeps
the open ancestors alone: a step's node counts where a node of the step before is open around it (its parent, for a
child). Rules go by ``scope``, so that many recipes can be read at once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.sources.tree import classes_of, seen_text

#: Most bytes of one value, of all values of a page, items of a page, and steps of a selector after the first.
MOST_VALUE, MOST_VALUES, MOST_ITEMS, MOST_STEPS = 65_535, 1 << 20, 200, 7
#: The field whose matches are the items of a list page, and the one whose matches leave a page before it is read.
ITEM, REMOVE = "*item", "*remove"

_ATTRIBUTE = r"""\[\s*([A-Za-z_][\w:-]*)\s*(?:([~^$*]?=)\s*("[^"\\]*"|'[^'\\]*'|[^\]\s"'\\]+)\s*)?\]"""
_COMPOUND = re.compile(rf"(\*|[A-Za-z][A-Za-z0-9-]*)?((?:#[A-Za-z0-9_-]+|\.[A-Za-z0-9_-]+|{_ATTRIBUTE})*)")
_PART = re.compile(rf"#([A-Za-z0-9_-]+)|\.([A-Za-z0-9_-]+)|{_ATTRIBUTE}")
_NAMED = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
STEP = T.StructType([T.StructField("child", T.BooleanType()), *_NAMED("tag", "id"), T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("attrs", T.ArrayType(_NAMED("name", "op", "value")))])


def selector_steps(selector: str) -> list[dict] | None:
    """The steps of a selector; None where it is not of the subset."""
    out, at, text = [], 0, selector.strip(" ")
    while at < len(text):
        gap = re.compile(r" *(>?) *").match(text, at)
        if out and not gap[0] or not out and gap[1]:
            return None
        at = gap.end()
        found = _COMPOUND.match(text, at)
        if found.end() == at:
            return None
        at = found.end()
        step = {"child": gap[1] == ">", "tag": found[1].lower() if found[1] not in (None, "*") else None, "id": None, "classes": [], "attrs": []}
        for part in _PART.finditer(found[2]):
            if part[1] is not None:
                if step["id"] not in (None, part[1]):
                    return None
                step["id"] = part[1]
            elif part[2] is not None:
                step["classes"].append(part[2])
            else:
                value = part[5]
                if value is not None and value[0] in "\"'":
                    value = value[1:-1]
                step["attrs"].append({"name": part[3].lower(), "op": part[4], "value": value})
        out.append(step)
    return out if 0 < len(out) <= MOST_STEPS + 1 else None


@F.pandas_udf(T.ArrayType(STEP))
def steps_of(selector: pd.Series) -> pd.Series:
    return selector.map(selector_steps, na_action="ignore")


def _fits(node: Column, step: Column) -> Column:
    classes = classes_of(node.attrs)

    def attribute(a: Column) -> Column:
        held = F.coalesce(F.try_element_at(node.attrs, a["name"]), F.lit(""))
        same = F.when(a.op == "=", held == a.value).when(a.op == "~=", F.array_contains(F.split(held, r"\s+"), a.value))
        same = same.when(a.op == "^=", (a.value != "") & held.startswith(a.value)).when(a.op == "$=", (a.value != "") & held.endswith(a.value))
        same = same.when(a.op == "*=", (a.value != "") & held.contains(a.value)).otherwise(F.lit(True))
        return F.map_contains_key(node.attrs, a["name"]) & same

    whole = (step.tag.isNull() | (step.tag == node.tag)) & (step.id.isNull() | (step.id == F.coalesce(node.attrs["id"], F.lit(""))))
    return whole & F.forall(step.classes, lambda c: F.array_contains(classes, c)) & F.forall(step.attrs, attribute)


def select(trees: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, scope, field, found``: the nodes (``pre, end``) of each rule's selector, in document order.

    ``trees`` have ``page_id, scope, nodes``, ``rules`` have ``scope, field, selector``; what no reader sees is not found.
    """
    steps = rules.select("scope", "field", F.posexplode(steps_of("selector")).alias("at", "step"), F.size(steps_of("selector")).alias("n"))
    key = F.coalesce(F.concat(F.lit("#"), F.col("step.id")), F.concat(F.lit("."), F.get("step.classes", F.lit(0))), F.col("step.tag"), F.lit("*"))
    steps = steps.select("scope", "field", "at", "step", (F.col("at") == F.col("n") - 1).alias("last"), key.alias("key"))
    nodes = trees.select("page_id", "scope", F.explode(F.filter("nodes", lambda n: (n.tag != "#text") & ~n.hidden)).alias("node"))
    keys = F.concat(F.array(F.lit("*"), F.col("node.tag")), F.transform(classes_of(F.col("node.attrs")), lambda c: F.concat(F.lit("."), c)), F.array_compact(F.array(F.concat(F.lit("#"), F.col("node.attrs")["id"]))))
    met = nodes.withColumn("key", F.explode(F.array_distinct(keys))).join(steps, ["scope", "key"]).where(_fits(F.col("node"), F.col("step")))
    candidate = F.struct(F.col("node.pre").alias("pre"), "at", F.col("node.end").alias("end"), F.col("node.parent").alias("parent"), F.col("step.child").alias("child"), "last")
    each = met.groupBy("page_id", "scope", "field").agg(F.sort_array(F.collect_list(candidate)).alias("candidates"))

    def walk(state: Column, c: Column) -> Column:
        # the open nodes are ancestors of this place: no more than a page is deep, for each step
        around = F.filter(state.open, lambda o: o.end >= c.pre)
        fits = F.exists(around, lambda o: (o.at == c["at"] - 1) & (o.pre < c.pre) & (~c.child | (o.pre == c.parent)))
        counts = (c["at"] == 0) | fits
        opened = F.when(counts & ~c.last, F.concat(around, F.array(F.struct(c.pre.alias("pre"), c.end.alias("end"), c["at"].alias("at"))))).otherwise(around)
        found = F.when(counts & c.last, F.concat(state.found, F.array(F.struct(c.pre.alias("pre"), c.end.alias("end"))))).otherwise(state.found)
        return F.struct(opened.alias("open"), found.alias("found"))

    start = F.struct(F.array().cast("array<struct<pre:int,end:int,at:int>>").alias("open"), F.array().cast("array<struct<pre:int,end:int>>").alias("found"))
    found = each.select("page_id", "scope", "field", F.aggregate("candidates", start, walk, lambda s: s.found).alias("found"))
    return found.where(F.size("found") > 0)


def read_fields(trees: DataFrame, rules: DataFrame, most_items: int | None = MOST_ITEMS, limited: bool = True) -> DataFrame:
    """``page_id, scope, item, values, error`` for each item of each page.

    ``rules`` have ``scope, field, selector, read, attr``, with ``read`` of ``text``, ``paragraphs``, ``attr`` or ``noise`` (a
    value where links hold over 35 % of the characters). A rule for
    ``ITEM`` makes its matches the items of its pages, else the page is the one item 0; a field is the first match inside its
    item. Matches of ``REMOVE`` are not read. A list page without items has no rows. Values beyond the limits, if ``limited``, or
    more than ``most_items`` of a page (None: any number), make the error ``resource_limit``.
    """
    several = rules.withColumn("field", F.when(F.col("field") == REMOVE, F.concat("field", "selector")).otherwise(F.col("field")))
    found = select(trees, several)
    by_page = found.groupBy("page_id", "scope").agg(F.map_from_entries(F.collect_list(F.struct("field", "found"))).alias("found"))
    plan = rules.groupBy("scope").agg(F.collect_list(F.when(~F.col("field").isin(ITEM, REMOVE), F.struct("field", "read", "attr"))).alias("reads"), F.bool_or(F.col("field") == ITEM).alias("listed"))
    pages = trees.where("nodes is not null").select("page_id", "scope", "nodes").join(plan, "scope").join(by_page, ["page_id", "scope"], "left")
    none = F.array().cast("array<struct<pre:int,end:int>>")
    of = lambda field: F.coalesce(F.try_element_at("found", field), none)
    gone = F.flatten(F.map_values(F.map_filter(F.coalesce("found", F.create_map().cast("map<string,array<struct<pre:int,end:int>>>")), lambda k, v: F.startswith(k, F.lit(REMOVE)))))
    away = lambda n: F.exists(F.col("gone"), lambda r: (n.pre >= r.pre) & (n.pre <= r.end))
    hide = F.transform("nodes", lambda n: F.struct(n.pre.alias("pre"), n.end.alias("end"), n.parent.alias("parent"), n.depth.alias("depth"), n.tag.alias("tag"), n.attrs.alias("attrs"), n.text.alias("text"), (n.hidden | away(n)).alias("hidden")))
    pages = pages.withColumn("gone", gone).withColumn("nodes", F.when(F.size("gone") > 0, hide).otherwise(F.col("nodes")))
    whole = F.array(F.struct(F.lit(-1).alias("pre"), (F.size("nodes") - 1).alias("end")))
    pages = pages.withColumn("roots", F.when(F.col("listed"), of(F.lit(ITEM))).otherwise(whole))
    # each item takes along its own part of the page only
    base = lambda root: F.greatest(root.pre, F.lit(0))
    inside = lambda root, field: F.filter(of(field), lambda m: (m.pre > root.pre) & (m.pre <= root.end) & ~away(m))
    first = lambda root: F.transform("reads", lambda r: F.struct(r.field.alias("field"), r["read"].alias("read"), r.attr.alias("attr"), F.get(inside(root, r.field), F.lit(0)).alias("at")))
    own = lambda root: F.struct(base(root).alias("base"), F.slice("nodes", base(root) + 1, root.end - base(root) + 1).alias("nodes"), first(root).alias("reads"))
    roots = F.col("roots") if most_items is None else F.slice("roots", 1, most_items)
    many = F.lit(False) if most_items is None else F.size("roots") > most_items
    items = pages.select("page_id", "scope", many.alias("many"), F.posexplode(F.transform(roots, own)).alias("item", "own"))
    rows = items.select("page_id", "scope", "item", "many", F.col("own.base").alias("base"), F.col("own.nodes").alias("nodes"), F.explode_outer("own.reads").alias("read")).withColumn("at", F.col("read.at"))
    below = lambda n: F.slice("nodes", n.pre - F.col("base") + 1, n.end - n.pre + 1)
    part = below(F.col("at"))
    text = seen_text(part)
    paragraphs = F.filter(F.transform(F.filter(part, lambda n: (n.tag == "p") & ~n.hidden), lambda p: seen_text(below(p))), lambda p: p != "")
    value = F.when(F.col("read.read") == "attr", F.try_element_at(F.get("nodes", F.col("at.pre") - F.col("base")).attrs, F.col("read.attr")))
    links = F.aggregate(F.filter(part, lambda n: (n.tag == "a") & ~n.hidden), F.lit(0), lambda a, n: a + F.length(seen_text(below(n))))
    value = value.when(F.col("read.read") == "noise", F.when(links > F.length(text) * 0.35, "noisy"))
    value = value.when((F.col("read.read") == "paragraphs") & (F.size(paragraphs) > 0), F.array_join(paragraphs, "\n\n")).otherwise(text)
    values = rows.select("page_id", "scope", "item", "many", F.col("read.field").alias("field"), F.nullif(F.btrim(F.when(F.col("at").isNotNull(), value)), F.lit("")).alias("value"))
    size = F.coalesce(F.octet_length("value"), F.lit(0))
    entry = F.when(F.col("value").isNotNull(), F.struct("field", "value"))
    told = values.groupBy("page_id", "scope", "item").agg(F.map_from_entries(F.collect_list(entry)).alias("values"), F.max(size).alias("most"), F.sum(size).alias("sum"), F.bool_or("many").alias("many"))
    over = F.col("many") | F.lit(limited) & ((F.col("most") > MOST_VALUE) | (F.col("sum") > MOST_VALUES))
    return told.select("page_id", "scope", "item", F.when(~over, F.col("values")).alias("values"), F.when(over, "resource_limit").alias("error"))
