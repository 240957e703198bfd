"""Reducer for JSON texts.

A JSON text is one cell. Its containers are opened level by level with ``explode``; each level adds
one narrow step and no shuffle, and only the finished output lines are grouped back into a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.knobs import knob
from linesieve.functions.text import json_value, let, strip_ansi
from linesieve.operators.lines import ID

CLOSE = 2**40  # place of a closing bracket among its children

# Possessive loops: long strings are read in a loop, not by recursion.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_ESCAPE = r'\\(?:u[0-9a-fA-F]{4}|.)'
_STRONG_KEY = '"(?i:' + "|".join(P.JSON_STRONG_KEYS) + ')"'
_EMPTY_SCALAR = r'(?:null|false|""|-?0(?:\.0+)?(?:[eE][-+]?\d+)?(?=[,}\]]))'


# ---- critical content -------------------------------------------------------------------------

def is_critical_json(value: Column) -> Column:
    """A string with a decisive word, or a strong key with a set value, at any depth.

    Works on the compact text of the value: after escapes are blanked, a quoted run that is not
    followed by a colon is a string value.
    """
    plain = F.regexp_replace(value, _ESCAPE, " ")
    words = P.JSON_CRITICAL_WORDS.replace("(?iU)", "")
    said = plain.rlike(f'(?iU)"[^"]*{words}[^"]*"(?!:)')
    strong = plain.rlike(_STRONG_KEY + r":(?!" + _EMPTY_SCALAR + r"|\[\]|\{\})")
    return said | strong


def critical_values(value: Column) -> Column:
    """Distinct critical strings, and set scalars of strong keys, of a compact JSON text."""
    tokens = F.regexp_extract_all(value, F.lit(f"({_STRING}:?)"), F.lit(1))
    quoted = F.filter(tokens, lambda t: ~F.endswith(t, F.lit('":')))
    strings = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    said = F.filter(strings, lambda s: s.rlike(P.JSON_CRITICAL_WORDS))
    scalar = rf"{_STRONG_KEY}:(?!{_EMPTY_SCALAR})(true|-?\d[0-9.eE+-]*|{_STRING})"
    raw = F.regexp_extract_all(value, F.lit(scalar), F.lit(1))
    strong = F.transform(
        raw,
        lambda s: F.when(s == "true", "True")
        .when(F.startswith(s, F.lit('"')), F.element_at(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), 1))
        .otherwise(s),
    )
    return F.array_distinct(F.concat(said, strong))


# ---- node table -------------------------------------------------------------------------------

def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def json_nodes(outputs: DataFrame, text_col: str = "text", max_depth: int = P.JSON_MAX_DEPTH) -> DataFrame:
    """All values of a JSON text: ``path`` (child positions), ``key``, ``depth``, ``json``.

    Values below the depth limit stay inside their ancestor's ``json``.
    """
    def node(path, key, depth, v, todo):
        return F.struct(path.alias("path"), key.alias("key"), F.lit(depth).alias("depth"), v.alias("v"), F.lit(todo).alias("todo"))

    root = node(F.array().cast("array<long>"), F.lit(None).cast("string"), 0, json_value(text_col), True)
    rows = outputs.select(ID, root.alias("n")).where(F.col("n.v").isNotNull())
    for depth in range(max_depth):
        n = F.col("n")
        kids = F.transform(
            F.coalesce(as_array(n["v"]), F.array().cast("array<variant>")),
            lambda x, i: node(F.concat(n["path"], F.array(i.cast("long"))), F.lit(None).cast("string"), depth + 1, x, True),
        )
        fields = F.transform(
            F.coalesce(F.map_entries(as_map(n["v"])), F.array().cast("array<struct<key:string,value:variant>>")),
            lambda e, i: node(F.concat(n["path"], F.array(i.cast("long"))), e["key"], depth + 1, e["value"], True),
        )
        done = F.array(node(n["path"], n["key"], depth, n["v"], False))
        opened = F.when(n["todo"] & (n["depth"] == depth), F.concat(done, kids, fields)).otherwise(F.array(n))
        rows = rows.select(ID, F.explode(opened).alias("n"))
    return rows.select(ID, "n.path", "n.key", "n.depth", F.to_json(F.col("n.v")).alias("json"))


# ---- reduction --------------------------------------------------------------------------------

def _line(path: Column, text: Column, v: Column | None = None, depth=0, dropped=0) -> Column:
    """A queue entry: a finished line, or (with ``v``) a value still to be opened behind ``text``."""
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.struct(
        path.alias("path"), text.alias("text"),
        (v if v is not None else F.lit(None).cast("variant")).alias("v"),
        as_int(depth).alias("depth"), as_int(dropped).alias("dropped"),
    )


def _at(path: Column, *steps) -> Column:
    return F.concat(path, F.array(*[(s if isinstance(s, Column) else F.lit(s)).cast("long") for s in steps]))


def _quoted(key: Column) -> Column:
    return F.concat(F.regexp_extract(F.to_json(F.array(key)), r"(?s)^\[(.*)\]\z", 1), F.lit(": "))


def _picked(items: Column, cap: Column) -> Column:
    """Kept positions of a long array: every critical item, and edges as far as the cap leaves room."""
    n = F.size(items)
    def choose(critical):
        every = F.sequence(F.lit(0), n - 1)
        is_hit = lambda i: F.get(critical, i)
        wanted = F.filter(every, lambda i: (i < P.JSON_HEAD_ITEMS) | (i >= n - P.JSON_TAIL_ITEMS) | is_hit(i))
        return let(
            wanted,
            lambda w: F.when(F.size(w) <= cap, w).otherwise(
                let(
                    F.filter(w, is_hit),
                    lambda hits: F.array_sort(
                        F.concat(
                            hits,
                            F.slice(F.filter(w, lambda i: ~is_hit(i)), F.lit(1), F.greatest(cap - F.size(hits), F.lit(0))),
                        )
                    ),
                )
            ),
        )
    return let(F.transform(items, lambda x: is_critical_json(F.to_json(x))), choose)


def _numbers(items: Column) -> Column:
    """Lines ``"key": {"min": ..}`` for number fields present in enough items."""
    least = F.greatest(F.lit(3), F.floor(F.size(items) / 3))
    entries = F.flatten(
        F.transform(
            items,
            lambda x: F.transform(
                F.filter(
                    F.coalesce(F.map_entries(as_map(x)), F.array().cast("array<struct<key:string,value:variant>>")),
                    lambda e: F.to_json(e["value"]).rlike(r"^-?\d"),
                ),
                lambda e: F.struct(e["key"].alias("k"), F.try_variant_get(e["value"], "$", "double").alias("x")),
            ),
        )
    )
    def summary(k, xs):
        mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
        body = F.struct(F.array_min(xs).alias("min"), F.array_max(xs).alias("max"), mean.alias("mean"))
        return F.concat(_quoted(k), F.to_json(body))
    def per_key(es):
        keys = F.array_distinct(F.transform(es, lambda e: e["k"]))
        texts = F.transform(
            keys,
            lambda k: let(
                F.transform(F.filter(es, lambda e: e["k"] == k), lambda e: e["x"]),
                lambda xs: F.when(F.size(xs) >= least, summary(k, xs)),
            ),
        )
        return F.filter(texts, lambda t: t.isNotNull())
    return let(entries, per_key)


def _open_array(q: Column, items: Column, cap: Column) -> Column:
    path, depth = q["path"], q["depth"] + 1
    whole = F.concat(
        F.array(_line(path, F.concat(q["text"], F.lit("[")))),
        F.transform(items, lambda x, i: _line(_at(path, i), F.lit(""), x, depth)),
        F.array(_line(_at(path, CLOSE), F.lit("]"))),
    )
    def sampled(keep):
        sample = lambda i: F.array(
            _line(_at(path, 0, 2, i), F.lit("{")),
            _line(_at(path, 0, 2, i, 0), F.concat(F.lit('"_index": '), i.cast("string"))),
            _line(_at(path, 0, 2, i, 1), F.lit('"value": '), F.get(items, i), depth),
            _line(_at(path, 0, 2, i, CLOSE), F.lit("}")),
        )
        number = lambda label, n: F.concat(F.lit(label), n.cast("string"))
        frame = F.array(
            _line(path, F.concat(q["text"], F.lit("{")), dropped=F.size(items) - F.size(keep)),
            _line(_at(path, 0), F.lit('"_sampled_array": {')),
            _line(_at(path, 0, 0), number('"total_items": ', F.size(items))),
            _line(_at(path, 0, 1), number('"sampled_items": ', F.size(keep))),
            _line(_at(path, 0, 2), F.lit('"samples": [')),
            _line(_at(path, 0, 2, CLOSE), F.lit("]")),
            _line(_at(path, 0, CLOSE), F.lit("}")),
            _line(_at(path, CLOSE), F.lit("}")),
        )
        fields = let(
            _numbers(items),
            lambda t: F.when(F.size(t) == 0, F.array(_line(path, F.lit("")))).otherwise(
                F.concat(
                    F.array(_line(_at(path, 0, 3), F.lit('"numeric_fields": {'))),
                    F.transform(t, lambda x, i: _line(_at(path, 0, 3, i), x)),
                    F.array(_line(_at(path, 0, 3, CLOSE), F.lit("}"))),
                )
            ),
        )
        return F.concat(frame, F.flatten(F.transform(keep, sample)), F.filter(fields, lambda l: l["text"] != ""))

    return (
        F.when(F.size(items) == 0, F.array(_line(path, F.concat(q["text"], F.lit("[]")))))
        .when(F.size(items) <= cap, whole)
        .otherwise(let(_picked(items, cap), sampled))
    )


def _open_map(q: Column, fields: Column) -> Column:
    path, depth = q["path"], q["depth"] + 1
    return F.when(F.size(fields) == 0, F.array(_line(path, F.concat(q["text"], F.lit("{}"))))).otherwise(
        F.concat(
            F.array(_line(path, F.concat(q["text"], F.lit("{")))),
            F.transform(fields, lambda e, i: _line(_at(path, i), _quoted(e["key"]), e["value"], depth)),
            F.array(_line(_at(path, CLOSE), F.lit("}"))),
        )
    )


def _folded(v: Column) -> Column:
    """Stand-in for a value below the depth limit; its critical values stay visible."""
    said = let(
        critical_values(F.to_json(v)),
        lambda c: F.when(F.size(c) > 0, F.concat(F.lit(', "_critical": '), F.to_json(c))).otherwise(""),
    )
    return F.concat(F.lit('{"_nested": "value available in the original"'), F.coalesce(said, F.lit("")), F.lit("}"))


def reduce_json(outputs: DataFrame, profile: str | None = None, text_col: str = "text") -> DataFrame:
    """Keys stay, long arrays keep edge and critical items with number summaries; one text per output."""
    if profile is not None:
        outputs = outputs.withColumn("profile", F.lit(profile))
    start = _line(F.array().cast("array<long>"), F.lit(""), json_value(strip_ansi(text_col)))
    rows = outputs.select(ID, knob("json_cap").alias("cap"), start.alias("q")).where(F.col("q.v").isNotNull())
    q, cap = F.col("q"), F.col("cap")
    opened = let(
        F.struct(as_array(q["v"]).alias("a"), F.map_entries(as_map(q["v"])).alias("m")),
        lambda c: F.when(c["a"].isNotNull(), _open_array(q, c["a"], cap))
        .when(c["m"].isNotNull(), _open_map(q, c["m"]))
        .otherwise(F.array(_line(q["path"], F.concat(q["text"], F.to_json(q["v"]))))),
    )
    step = F.explode(F.when(q["v"].isNotNull(), opened).otherwise(F.array(q))).alias("q")
    for _ in range(P.JSON_MAX_DEPTH + 1):
        rows = rows.select(ID, "cap", step)
    deep = q["v"].isNotNull()
    closing = F.element_at(q["path"], -1) == CLOSE
    indent = 2 * (F.size(q["path"]) - F.when((F.size(q["path"]) > 0) & closing, 1).otherwise(0))
    body = F.when(deep, F.concat(q["text"], _folded(q["v"]))).otherwise(q["text"])
    comma = F.when(F.substring(body, -1, 1).isin("{", "["), F.lit("")).otherwise(F.lit(","))
    done = rows.select(
        ID, q["path"].alias("path"), F.concat(F.repeat(F.lit(" "), indent), body, comma).alias("line"),
        F.when(deep, 1).otherwise(q["dropped"]).alias("dropped"),
    )
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n"
    )
    return done.groupBy(ID).agg(
        F.regexp_replace(F.regexp_replace(joined, r",(\n *[}\]])", "$1"), r",\z", "").alias("view"),
        F.sum("dropped").alias("omitted_lines"),
    )
