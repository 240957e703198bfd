"""Reducer for file listings: hierarchy rebuilding, groups by top component, suffix counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesieve.functions import patterns as P
from linesieve.functions.knobs import knob
from linesieve.functions.predicates import forward_slashes, is_key_file, suffix, top_component
from linesieve.functions.text import strip
from linesieve.operators.chunks import ALL, BEFORE, BLOCK, CHUNK, carry, numbered, with_chunk
from linesieve.operators.detect import is_tree_noise, tree_depth
from linesieve.operators.lines import ID, LINE, NO, VIEW, carry_section, emit, is_spread_anchor, marker, view_row
from linesieve.sources.staging import stage

KEYS, TOPS, GROUPS, BODY, SUFFIXES = 1, 2, 3, 4, 5


TREE_BLOCK = 256  # lines of a tree folded in one step


def rebuild_tree_paths(lines: DataFrame, size: int = BLOCK, block: int = TREE_BLOCK) -> DataFrame:
    """Full paths of a drawn tree: ``line_no``, ``depth``, ``value``.

    A node's ancestor at level k is the latest earlier node of level k. A block of lines is folded over a stack that
    holds the latest name of every level; the stack it ends with is the block's summary. Of two neighbouring summaries
    the later one's names count, and the earlier one's where it has none, so what a block finds open at its begin is,
    level by level, the latest name in the summaries before. There is a row per block and level, none per node and level.
    """
    extra = [c for c in lines.columns if c not in (ID, NO, LINE)]
    nodes = lines.where(~is_tree_noise(F.col(LINE)) & F.col(LINE).rlike(P.TREE_NODE)).select(
        ID, *extra, F.floor(F.col(NO) / block).cast("long").alias("block"),
        F.struct(NO, tree_depth(F.col(LINE)).cast("int").alias("depth"), F.regexp_extract(LINE, P.TREE_NODE, 2).alias("name")).alias("node"),
    )
    # At most ``block`` nodes of a block come together.
    blocks = nodes.groupBy(ID, "block").agg(F.array_sort(F.collect_list("node")).alias("nodes"), *[F.first(c).alias(c) for c in extra])
    blocks = blocks.withColumn("fold", _fold_nodes(F.col("nodes")))
    last, deepest = F.col("fold.stack"), F.array_max(F.transform("nodes", lambda x: x["depth"]))
    at = lambda order, level, name: F.struct(order.alias("at"), level.cast("int").alias("level"), name.cast("string").alias("name"))
    given = F.transform(last, lambda name, k: at(F.col("block") * 2 + 1, k, name))
    asked = F.transform(F.sequence(F.lit(0), deepest), lambda k: at(F.col("block") * 2, k, F.lit(None)))
    levels = blocks.select(ID, F.explode(F.concat(F.filter(given, lambda g: g["name"].isNotNull()), asked)).alias("l")).select(ID, "l.*")
    known = carry_section(levels, [ID, "level"], "at", F.col("name"), size, "part").where("at % 2 = 0")
    open_ = known.groupBy(ID, F.floor(F.col("at") / 2).cast("long").alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "part"))), lambda s: s["part"]).alias("before")
    )
    parts = lambda x: F.concat(
        F.transform(x["above"], lambda name, k: F.coalesce(name, F.get(F.col("before"), k))), F.array(x["name"])
    )
    rows = blocks.join(open_, [ID, "block"]).select(ID, *extra, "before", F.explode("fold.out").alias("x"))
    return rows.select(
        ID, F.col(f"x.{NO}").alias(NO), F.col("x.depth").cast("long").alias("depth"), *extra, F.array_join(parts(F.col("x")), "/").alias("value")
    )


def _fold_nodes(nodes: Column) -> Column:
    """The stack after all nodes, and each node with the names of the levels above it, NULL where the block has none."""
    level = lambda stack, k: F.get(stack, k)
    text = F.array().cast("array<string>")
    out = F.array().cast(f"array<struct<{NO}:bigint,depth:int,name:string,above:array<string>>>")

    def step(state, x):
        upto = F.greatest(F.size(state["stack"]), x["depth"] + 1) - 1
        stack = F.transform(F.sequence(F.lit(0), upto), lambda k: F.when(k == x["depth"], x["name"]).otherwise(level(state["stack"], k)))
        above = F.when(
            x["depth"] > 0, F.transform(F.sequence(F.lit(0), x["depth"] - 1), lambda k: level(state["stack"], k))
        ).otherwise(text)
        row = F.struct(x[NO].alias(NO), x["depth"].alias("depth"), x["name"].alias("name"), above.alias("above"))
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(row)).alias("out"))

    return F.aggregate(nodes, F.struct(text.alias("stack"), out.alias("out")), step)


def listing_items(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """Listed paths in order; rows with ``nested`` set come from a drawn tree."""
    if "nested" not in lines.columns:
        return flat_items(lines)
    flat = flat_items(lines.where(~F.col("nested")))
    drawn = rebuild_tree_paths(lines.where("nested"), size)
    return flat.unionByName(drawn.select(*flat.columns))


def flat_items(lines: DataFrame) -> DataFrame:
    extra = [c for c in lines.columns if c not in (ID, NO, LINE)]
    return lines.where(strip(LINE) != "").select(ID, NO, *extra, strip(LINE).alias("value"))


def group_by_top(items: DataFrame, size: int = BLOCK) -> DataFrame:
    """Add ``top``, its size ``n_group``, first place, and the position among its nested entries."""
    path = forward_slashes("value")
    marked = with_chunk(items, NO, size).withColumns({"path": path, "top": top_component("value")})
    bare = lambda c: F.regexp_replace(c, r"/+\z", "")
    marked = marked.withColumn("is_nested", bare(F.col("path")) != bare(F.col("top")))
    w = Window.partitionBy(ID, "top", CHUNK).orderBy(NO).rowsBetween(*(BEFORE[0], -1))
    nested = F.count_if("is_nested")
    local = marked.withColumn("_local", F.count(F.when(F.col("is_nested"), 1)).over(w))
    linked = carry(
        local, [ID, "top"],
        {
            "n_group": (F.count(F.lit(1)), F.sum, ALL),
            "first_no": (F.min(NO), F.min, ALL),
            "n_nested": (nested, F.sum, ALL),
            "_before": (nested, F.sum, BEFORE),
        },
    )
    return linked.withColumns(
        {
            "idx": F.col("_local") + F.coalesce("_before", F.lit(0)),
            "is_alone": (F.col("n_group") == 1) & (F.col("path") == F.col("top")),
        }
    ).drop("_local", "_before", CHUNK)


def extension_histogram(items: DataFrame, keys: list[str], order: str = NO, top: int | None = None) -> DataFrame:
    """Suffixes per group, most frequent first, all or the ``top`` ones; ties go to the one seen first."""
    counts = items.groupBy(*keys, suffix("value").alias("suffix")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_no")
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_no")
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def reduce_listing(lines: DataFrame, profile: str | None = None, size: int = BLOCK) -> DataFrame:
    """Totals, key files, single entries, sampled groups and suffix counts of a listing."""
    if profile is not None:
        lines = lines.withColumn("profile", F.lit(profile))
    columns = [ID, NO, LINE, "profile"] + (["nested"] if "nested" in lines.columns else [])
    items = listing_items(lines.select(*columns), size).select(ID, NO, "value", "profile")
    # Six sections read the grouped paths, so they are written once.
    grouped = stage(group_by_top(items, size), "listing")

    # Totals and group headings.
    tops = grouped.groupBy(ID, "top").agg(
        F.first("n_group").alias("n"), F.first("first_no").alias("first_no"), F.first("profile").alias("profile"),
        F.first("is_alone").alias("is_alone"), F.first("n_nested").alias("n_nested"),
    )
    budget = knob("tree_samples")
    shown = F.least(F.col("n_nested"), budget)
    hidden = F.col("n") - shown
    headings = emit(
        tops.where(~F.col("is_alone")),
        F.array(
            view_row(BODY, F.col("first_no"), F.concat(F.lit("- "), F.col("top"), marker("/ (", F.col("n"), ")")), o3=-1),
            F.when(
                hidden > 0,
                view_row(BODY, F.col("first_no"), marker("    … ", hidden, " more …"), hidden, o3=2**62),
            ),
        ),
    )
    totals = tops.groupBy(ID).agg(
        F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_tops"), F.count_if(~F.col("is_alone")).alias("n_groups"),
    )
    frame = emit(
        totals,
        F.array(
            view_row(
                0, 0,
                F.concat(
                    marker("Filesystem listing: ", F.col("n_items"), " entries, "),
                    marker("", F.col("n_tops"), " top-level groups"),
                ),
            ),
            F.when(F.col("n_groups") > 0, view_row(GROUPS, 0, F.lit("Groups:"))),
        ),
    )
    relative = F.when(
        F.startswith(F.col("path"), F.concat("top", F.lit("/"))), F.expr("substring(path, length(top) + 2)")
    ).otherwise(F.col("path"))
    members = emit(
        grouped.where(~F.col("is_alone") & F.col("is_nested"))
        .where(is_spread_anchor(F.col("idx"), F.col("n_nested"), budget)),
        F.array(view_row(BODY, F.col("first_no"), F.concat(F.lit("    "), relative), o3=F.col(NO))),
    )
    return (
        frame.unionByName(key_file_section(grouped)).unionByName(single_entry_section(grouped, size))
        .unionByName(headings).unionByName(members).unionByName(suffix_section(grouped)).select(*VIEW)
    )


def key_file_section(items: DataFrame) -> DataFrame:
    """Every key file, each value once, at its first place."""
    keys = items.where(is_key_file("value")).groupBy(ID, "value").agg(F.min(NO).alias("first_no"))
    listed = emit(keys, F.array(view_row(KEYS, F.col("first_no"), F.concat(F.lit("  "), F.col("value")))))
    heading = emit(keys.select(ID).distinct(), F.array(view_row(KEYS, -1, F.lit("Key files:"))))
    return listed.unionByName(heading)


def single_entry_section(grouped: DataFrame, size: int = BLOCK) -> DataFrame:
    """Entries without a group: spread ones, and every key file."""
    alone = numbered(
        grouped.where("is_alone").select(ID, NO, "value", "profile"), [ID], [NO], NO, size, "pos", "n_alone"
    )
    budget = knob("tree_top_samples")
    chosen = alone.where(is_spread_anchor(F.col("pos"), F.col("n_alone"), budget) | is_key_file("value"))
    listed = emit(chosen, F.array(view_row(TOPS, F.col(NO), F.concat(F.lit("  "), F.col("value")))))
    counts = chosen.groupBy(ID).agg(F.first("n_alone").alias("n"), F.count(F.lit(1)).alias("shown"))
    hidden = F.col("n") - F.col("shown")
    framed = emit(
        counts,
        F.array(
            view_row(TOPS, -1, marker("Top-level entries (", F.col("n"), "):")),
            F.when(hidden > 0, view_row(TOPS, 2**62, marker("  … ", hidden, " more …"), hidden)),
        ),
    )
    return listed.unionByName(framed)


def suffix_section(items: DataFrame, shown: int = P.TREE_EXTENSIONS_SHOWN) -> DataFrame:
    """The most frequent suffixes; a closing count stands for the others and their entries."""
    ranked = extension_histogram(items, [ID])
    others = F.col("rank") > shown
    pair = F.struct("rank", F.concat(F.col("suffix"), marker("=", F.col("n"), "")).alias("text"))
    joined = ranked.groupBy(ID).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(~others, pair))), lambda p: p["text"]), ", "
        ).alias("first"),
        F.count_if(others).alias("more"), F.sum(F.when(others, F.col("n"))).alias("entries"),
    )
    rest = F.when(
        F.col("more") > 0, F.concat(marker(", … ", F.col("more"), " more suffixes"), marker(" in ", F.col("entries"), " entries …"))
    ).otherwise("")
    return emit(joined, F.array(view_row(SUFFIXES, 0, F.concat(F.lit("Extensions: "), F.col("first"), rest))))


def listing_key_files(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """Key files must stay visible."""
    items = listing_items(lines, size)
    return items.where(is_key_file("value")).select(ID, F.col("value").alias(LINE)).distinct()
