"""Pivots, splits, nested documents, column choice and text layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from setwise.functions.texts import pad_left, thousands, wildcard_regex
from setwise.functions.times import elapsed_parts_text, int_div
from setwise.functions.xmlpath import BETWEEN, PARSE, few_nodes, open_tags, readable, step
from setwise.operators.aggregates import ordered_list


def dynamic_pivot(
    df: DataFrame, anchor: str, pivot: str, value: str, agg: str = "max", where: Column | None = None,
    as_text: bool = False, max_columns: int | None = None,
) -> DataFrame:
    """Long to wide with one column per distinct ``pivot`` value under the filter.

    The filter holds for discovery and data alike and NULL pivot values are
    left out. Every value becomes a column; a caller who cannot use more than
    ``max_columns`` of them gets an error instead of a cut. ``as_text`` gives
    all columns as whole texts.
    """
    rows = df if where is None else df.where(where)
    rows = rows.where(F.col(pivot).isNotNull())
    values = rows.select(pivot).distinct()
    found = [r[0] for r in (values.limit(max_columns + 1) if max_columns else values).collect()]
    if max_columns and len(found) > max_columns:
        raise ValueError(f"{pivot} has more than {max_columns} values")
    cell = F.call_function(agg, F.col(value))
    out = rows.groupBy(anchor).pivot(pivot, sorted(found)).agg(cell)
    if not as_text:
        return out
    return out.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in out.columns])


def static_pivot(df: DataFrame, anchor: Sequence[str], pivot: str, value: str, values: Sequence) -> DataFrame:
    """Pivot over a fixed list of values, MAX per cell."""
    return df.groupBy(*anchor).pivot(pivot, list(values)).agg(F.max(value))


def split_ordinal(
    df: DataFrame, text: str, pattern: str = ",", keep_empty: bool = True, ordinal: str = "ordinal", item: str = "item",
) -> DataFrame:
    """One row per piece of a delimited string: 1-based ordinal and trimmed piece."""
    out = df.select(
        *[c for c in df.columns if c != text], F.posexplode(F.split(text, pattern)).alias("__p", "__i")
    ).withColumns({ordinal: F.col("__p") + 1, item: F.trim("__i")}).drop("__p", "__i")
    return out if keep_empty else out.where(F.col(item) != "")


def xml_nodes(df: DataFrame, xml: str, row_tag: str, fields: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per ``row_tag`` child of the document root, with typed fields.

    ``fields`` maps element names, or ``_name`` for attributes, to types.
    Namespaces are ignored by the parser. Nodes missing a field give NULL for
    it, and text that is no XML has no nodes.
    """
    ddl = f"`{row_tag}` array<struct<{', '.join(f'`{n}`: {t}' for n, t in fields.items())}>>"
    parsed = F.from_xml(xml, ddl, PARSE)
    return df.select(*keep, F.explode(parsed[row_tag]).alias("__node")).select(
        *keep, *[F.col("__node")[n].alias(n.lstrip("_")) for n in fields]
    )


def xml_nodes_anywhere(
    df: DataFrame, xml: str, row_tag: str, fields: Mapping[str, str], keep: Sequence[str] = (), nesting: int = 2,
) -> DataFrame:
    """One row per ``row_tag`` element at any depth, with typed fields.

    ``fields`` maps child element names, or ``_name`` for attributes, to types;
    a node without one, or with an empty one, gives NULL for it, and of several
    children of one name the first counts, markup inside it left out. Names are
    compared without namespaces. Text that is no XML has no nodes. ``nesting``
    is how deep ``row_tag`` elements may stand inside each other; a document in
    which they go deeper is an error.

    Where tags alone show that there are few nodes and none inside another, one
    path gives all fields. Any other text is asked for each field: a path for
    the nodes and one field of each gives both in document order, nodes as NULL,
    values as text, so every value belongs to the last node before it. Nodes
    that stand inside others are asked for apart.
    """
    row, none = step(row_tag), F.array().cast("array<string>")
    inside = f"count(ancestor::{row})"
    found = lambda path: F.xpath(F.col("__xml"), F.lit(path))
    at = lambda level: f"//{row}[{inside}={level}]"

    def column(level: int, name: str) -> Column:
        values = f"{at(level)}/{step(name)}" if name.startswith("_") else f"{at(level)}/{step(name)}[1]//text()"
        # Each text is added to the last node's.
        return F.aggregate(found(f"{at(level)} | {values}"), none, lambda held, x: F.when(
            x.isNull(), F.concat(held, F.array(F.lit(None).cast("string")))).otherwise(F.concat(
                F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))),
                F.array(F.concat(F.coalesce(F.element_at(held, -1), F.lit("")), x)))))

    # Checked and rewritten once; deeper levels are looked at only where there are any.
    ready = df.select(*keep, readable(xml).alias("__xml")).where("__xml IS NOT NULL").withColumn("__tags", open_tags("__xml", row_tag))
    few, most = few_nodes("__xml", "__tags", row_tag, list(fields))
    ready = ready.withColumn("__few", F.split(few, BETWEEN))
    attributes = [name for name in fields if name.startswith("_")]
    places = F.slice(F.array(*[F.lit(k) for k in range(max(most, 1))]), F.lit(1), F.col("__tags"))

    def given(k: Column, i: int) -> Column:
        value = F.get("__few", k * len(fields) + (i + 1 + len(attributes)))
        return F.when(value != "", value)

    one = lambda i: lambda k: given(k, i)
    # The document has as many nodes as its tags say, and of each attribute as many as nodes that have a value of it.
    at_once = F.get("__few", F.lit(0)).cast("int") == F.col("__tags")
    for a, name in enumerate(attributes, 1):
        i = list(fields).index(name)
        at_once = at_once & (F.get("__few", F.lit(a)).cast("int") == F.size(F.array_compact(F.transform(places, one(i)))))
    at_once = (F.col("__tags") == 0) | F.coalesce(at_once, F.lit(False))
    at_once = F.coalesce(at_once, F.lit(False))
    ready = ready.withColumn("__at_once", at_once).withColumn(
        "__nested", F.when(~F.col("__at_once"), F.size(found(f"//{row}[{inside}>0]")) > 0))
    too_deep = F.col("__nested") & (F.size(found(at(nesting))) > 0)
    levels = [F.arrays_zip(*[column(level, name).alias(f"f{i}") for i, name in enumerate(fields)]) for level in range(nesting)]

    nodes = F.when(F.col("__at_once"), F.transform(places, lambda k: F.struct(*[given(k, i).alias(f"f{i}") for i in range(len(fields))]))).when(
        ~F.col("__nested"), levels[0]).when(
        too_deep, F.raise_error(F.lit(f"{row_tag} elements stand more than {nesting} deep inside each other"))).otherwise(F.concat(*levels))
    return ready.select(*keep, F.explode(nodes).alias("__node")).select(
        *keep, *[F.col(f"__node.f{i}").cast(t).alias(name.lstrip("_")) for i, (name, t) in enumerate(fields.items())])


def nested_counts(df: DataFrame, entity: str, group: str, item: str, name: str = "doc") -> DataFrame:
    """Per entity one document: groups in order, in each group its items with counts.

    Counting comes first, so the arrays hold distinct items, not rows.
    """
    counted = df.groupBy(entity, group, item).agg(F.count(F.lit(1)).alias("count"))
    groups = counted.groupBy(entity, group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(item).alias("name"), F.col("count")))).alias("items")
    )
    return groups.groupBy(entity).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(F.col(group).alias("group"), F.col("items"))))).alias(name)
    )


def append_fields(doc: Column, fields: Mapping[str, Column]) -> Column:
    """JSON of a struct with further fields; NULL ones do not appear."""
    for name, value in fields.items():
        doc = doc.withField(name, value)
    return F.to_json(doc)


def match_columns(columns: Sequence[str], wanted: Sequence[str], disabled: Sequence[str] = ()) -> list[str]:
    """Columns in the order of the wildcard patterns, each at its first match."""
    import re

    out: list[str] = []
    for pattern in wanted:
        rx = re.compile(wildcard_regex(pattern), re.IGNORECASE)
        out += [c for c in columns if c not in out and c not in disabled and rx.match(c)]
    if not out:
        raise ValueError(f"no column matches {list(wanted)}")
    return out


def bracketed(patterns: str) -> list[str]:
    """``[a%][b]`` to its patterns."""
    import re

    found = re.findall(r"\[((?:[^\[\]]|\[[^\]]*\])*)\]", patterns)
    if not found:
        raise ValueError(f"no bracketed pattern in {patterns!r}")
    return found


def select_like(df: DataFrame, patterns: str, disabled: Sequence[str] = ()) -> DataFrame:
    """Choose and order output columns by bracketed wildcard patterns."""
    return df.select(*match_columns(df.columns, bracketed(patterns), disabled))


def order_like(df: DataFrame, order: str) -> DataFrame:
    """Sort by ``[column] ASC`` / ``[column] DESC`` items, columns by wildcard."""
    import re

    keys, seen = [], set()
    for pattern, direction in re.findall(r"\[([^\]]+)\]\s*(ASC|DESC)?", order, re.IGNORECASE):
        for c in match_columns(df.columns, [pattern]):
            if c not in seen:
                seen.add(c)
                keys.append(F.col(c).desc() if direction.upper() == "DESC" else F.col(c).asc())
    if not keys:
        raise ValueError(f"no sort column in {order!r}")
    return df.orderBy(*keys)


def filter_pair(
    df: DataFrame, fields: Mapping[str, str], include: str = "", include_by: str = "", exclude: str = "", exclude_by: str = "",
) -> DataFrame:
    """One inclusive and one exclusive wildcard filter, each on a named field; empty is off.

    A NULL value never matches, so it fails the inclusive filter and passes
    the exclusive one.
    """
    for which in (w for w, p in ((include_by, include), (exclude_by, exclude)) if p):
        if which not in fields:
            raise ValueError(f"filter field {which!r} is not one of {sorted(fields)}")
    matches = lambda by, pattern: F.col(fields[by]).cast("string").rlike("(?i)" + wildcard_regex(pattern))
    if include:
        df = df.where(matches(include_by, include))
    if exclude:
        df = df.where(~F.coalesce(matches(exclude_by, exclude), F.lit(False)))
    return df


def aligned_thousands(df: DataFrame, columns: Mapping[str, int]) -> DataFrame:
    """Thousands-separated text, right-aligned to the widest value of the result.

    ``columns`` maps a column to its decimal places. The widths are one-row
    subqueries, so nothing is sorted or gathered.
    """
    texts = df.withColumns({c: thousands(c, places) for c, places in columns.items()})
    widths = {c: texts.agg(F.max(F.length(c))).scalar() for c in columns}
    return texts.withColumns({c: pad_left(F.col(c), widths[c]) for c in columns})


def aligned_elapsed(df: DataFrame, ms: str, name: str = "elapsed") -> DataFrame:
    """``dd hh:mm:ss.mss`` padded to the widest day count of the result (two digits at least)."""
    days = F.length(int_div(F.col(ms).cast("bigint"), 86_400_000).cast("string"))
    width = df.agg(F.max(days)).scalar()
    return df.withColumn(name, elapsed_parts_text(ms, F.greatest(F.coalesce(width, F.lit(2)), F.lit(2))))


# Darker characters stand for larger numbers.
RAMP = " .:-=+*#%@"


def grid_axes(df: DataFrame, x: tuple[str, int, int], y: tuple[str, int, int]) -> DataFrame:
    """Every (x, y) cell of two integer axes, from one row of ``df``'s session.

    Both axes are literal ranges, so this unnests arrays; nothing is joined.
    """
    (xn, x0, x1), (yn, y0, y1) = x, y
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias(xn)).select(
        xn, F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias(yn)
    )


def char_ramp_grid(
    df: DataFrame, x: tuple[str, int, int], y: tuple[str, int, int], ramp: str = RAMP, name: str = "line",
) -> DataFrame:
    """Row counts on a fixed grid as characters: one text line per y.

    A cell's character is its count's share of the largest count.
    """
    counted = df.groupBy(x[0], y[0]).agg(F.count(F.lit(1)).alias("__n"))
    grid = grid_axes(df, x, y).join(counted, [x[0], y[0]], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    peak = counted.agg(F.max("__n")).scalar()
    level = F.coalesce(int_div(F.col("__n") * (len(ramp) - 1), peak), F.lit(0)).cast("int")
    cell = F.substring(F.lit(ramp), level + 1, F.lit(1))
    return grid.withColumn("__c", cell).groupBy(y[0]).agg(ordered_list("__c", "", x[0]).alias(name))
