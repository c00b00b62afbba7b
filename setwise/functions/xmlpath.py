"""Reading XML text columns with Spark's own parsers.

Names are compared without their namespace prefix by asking for local names;
values are never edited, so CDATA and what looks like markup in it stay.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from setwise.functions.times import col

_BAD = "__not_xml"
PARSE = {"ignoreNamespace": "true"}
BETWEEN = "\u0001"  # no XML 1.0 text holds it
OPERATORS = 100  # so many the parser takes in one path


def quoted(text: str) -> str:
    """An XPath literal for any text: what holds both quotes is put together from parts."""
    if '"' not in text:
        return f'"{text}"'
    if "'" not in text:
        return f"'{text}'"
    parts = [f'"{part}"' for part in text.split('"')]
    return f"""concat({", '\"', ".join(parts)})"""


def step(name: str) -> str:
    """An element of that local name, or with a leading underscore an attribute."""
    return f"@*[local-name()={quoted(name[1:])}]" if name.startswith("_") else f"*[local-name()={quoted(name)}]"


def is_xml(xml: Column | str) -> Column:
    """Whether the text parses; a document that declares entities of its own and uses them does not."""
    options = PARSE | {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"}
    return F.from_xml(col(xml), f"__any string, {_BAD} string", options)[_BAD].isNull() & col(xml).isNotNull()


def xml_escape(x: Column | str) -> Column:
    out = col(x)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def cdata_as_text(xml: Column | str) -> Column:
    """The same document with its CDATA sections written as escaped text.

    A path gives of a run of text and CDATA only the first part; of escaped text it gives all.
    """
    opened = F.lit("<![CDATA[")
    pieces = F.split(col(xml), r"<!\[CDATA\[")

    def rewritten(piece: Column, i: Column) -> Column:
        end = F.instr(piece, "]]>")
        inside, rest = F.substr(piece, F.lit(1), end - 1), F.substr(piece, end + 3)
        return F.when(i == 0, piece).when(end == 0, F.concat(opened, piece)).otherwise(F.concat(xml_escape(inside), rest))

    return F.when(F.contains(col(xml), opened), F.array_join(F.transform(pieces, rewritten), "")).otherwise(col(xml))


def readable(xml: Column | str) -> Column:
    """The document for paths that ask for texts, or NULL for text that is no XML."""
    return F.when(is_xml(xml), cdata_as_text(xml))


def value_by_sibling(xml: Column | str, row: str, name: str, value_tag: str = "Value", name_tag: str = "Name") -> Column:
    """Text of ``value_tag`` in the first ``row`` element whose ``name_tag`` equals ``name``, '' without one; NULL for text that is no XML."""
    path = f"//{step(row)}/{step(value_tag)}[../{step(name_tag)}={quoted(name)}]"
    return F.when(is_xml(xml), F.xpath_string(col(xml), F.lit(path)))


def open_tags(xml: Column | str, name: str) -> Column:
    """How many elements of that local name the document has, if its tags alone show that none is inside another; else NULL.

    Outside of comments, instructions and declarations ``<`` only begins a tag. An empty-element tag counts as left open.
    """
    tag = rf"<(/?)(?:[^\s<>/:]+:)?\Q{name}\E(?=[\s/>])"
    tags = F.array_join(F.transform(F.regexp_extract_all(col(xml), F.lit(tag), F.lit(1)), lambda x: F.when(x == "", "<").otherwise(x)), "")
    plain = ~F.contains(col(xml), F.lit("<!")) & ~F.contains(col(xml), F.lit("<?"))
    return F.when(plain & ~F.contains(tags, F.lit("<<")), F.length(F.replace(tags, F.lit("/"))))


def few_nodes(xml: Column | str, count: Column | str, name: str, fields: Sequence[str]) -> tuple[Column, int]:
    """A text cut by ``BETWEEN``, NULL without a count or for more nodes than it may hold, and how many these are.

    It gives the number of nodes, that of all attributes for each attribute field, and the fields of each node, '' for none.
    Each path holds as many fields as the parser takes, and only as many paths are made as there are fields.
    """
    node = f"//{step(name)}"
    paths, ends = [[f"count({path})" for path in (node, *[f"{node}/{step(f)}" for f in fields if f.startswith("_")])]], []
    taken = lambda values: 1 + sum(len(re.findall(r"//|[/(\[*=@]", re.sub(r"\"[^\"]*\"|'[^']*'", "", v))) for v in values)
    most = 0
    while taken(paths[0]) <= OPERATORS and len(paths) <= max(len(fields), 1):
        k, i = divmod(most, max(len(fields), 1))
        value = f"string(({node})[{k + 1}]/{step(fields[i])})" if fields else ""
        if not fields or taken([value]) > OPERATORS:
            break
        if taken([*paths[-1], value]) > OPERATORS:
            ends.append(most)
            paths.append([])
        paths[-1].append(value)
        most += 1
    # The last path is over the number of paths, or holds nothing that could be asked for.
    paths, most = (paths[: len(ends)], ends[-1]) if ends and fields else ([], 0)
    most_nodes = most // max(len(fields), 1)
    asked = [F.xpath_string(col(xml), F.lit(f"concat({f", '{BETWEEN}', ".join([*values, "''"])})")) for values in paths]
    wanted = col(count) * len(fields)
    more = [F.when(wanted > end, text).otherwise("") for end, text in zip(ends, asked[1:])]
    return F.when(col(count).between(1, most_nodes), F.concat(*asked[:1], *more)) if asked else F.lit(None).cast("string"), most_nodes
