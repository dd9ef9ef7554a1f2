"""Text keys, fingerprints and limits."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Characters folded to a plain dash or quote.
CARD_KEY_DASHES = "–—−"
NAME_DASHES, NAME_QUOTES = "–—", "’"
SOME_ROWS = 256  # texts of a batch that are Python objects at a time


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Full case folding as Unicode has it: letters that fold to one letter, from and to, and those that fold to more."""
    one, many = [], {}
    for i in range(0x80, 0x110000):
        c = chr(i)
        if not 0xD800 <= i < 0xE000 and c.casefold() != c:
            if len(c.casefold()) == 1:
                one.append(c)
            else:
                many[c] = c.casefold()
    return "".join(one), "".join(c.casefold() for c in one), many


def casefold(c: Column) -> Column:
    """Full case folding: equal to Python's for every text.

    Expressions only, as keys are made inside lambdas. ASCII texts are lower-cased; only texts with a letter that folds
    to several are taken apart.
    """
    one, folded, many = _folding()
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    single = F.translate(c, upper + one, upper.lower() + folded)
    table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    spelled = F.array_join(F.transform(F.regexp_extract_all(single, F.lit("(?s)(.)"), F.lit(1)), lambda x: F.coalesce(
        F.try_element_at(table, x), x)), "")
    return F.when(~c.rlike(r"[^\x00-\x7F]"), F.lower(c)).when(
        c.rlike("[" + "".join(many) + "]"), spelled).otherwise(single)


def card_key(c: Column) -> Column:
    """Dash-folded, case-folded, whitespace-squeezed key of an id or a name."""
    return _squeeze(F.translate(casefold(c), CARD_KEY_DASHES, "---"))


@F.pandas_udf(StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def normalized_name(c: Column) -> Column:
    """NFKC, dash/quote fold, whitespace squeeze, case fold.

    Only names with non-ASCII characters are sent to Python; the others stay in the JVM.
    """
    odd = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    base = F.coalesce(_compatible(odd), F.lower(c))
    return _squeeze(F.translate(base, NAME_DASHES + NAME_QUOTES, "--'"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def deck_fingerprint(cards) -> Column:
    """Hash of the card multiset of an array; NULL unless every entry is non-blank text.

    Equal cards are neighbours after one sort, so counting them is linear in the list.
    """
    c = F.col(cards) if isinstance(cards, str) else cards
    trimmed = F.transform(c, lambda x: F.trim(x))
    valid = (F.size(c) > 0) & F.forall(trimmed, lambda x: x.isNotNull() & (x != ""))

    def entry(card, count):
        quoted = F.to_json(F.struct(card.alias("v")))
        return F.concat(F.lit("["), quoted.substr(F.lit(6), F.length(quoted) - 6), F.lit(","),
                        count.cast("string"), F.lit("]"))

    def counted(ordered):
        tagged = F.transform(ordered, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        starts = F.filter(tagged, lambda t: (t["i"] == 0) | (F.get(ordered, t["i"] - 1) != t["x"]))
        return _let(starts, lambda s: F.transform(s, lambda t, j: entry(
            t["x"], F.coalesce(F.get(s, j + 1)["i"], F.size(ordered)) - t["i"])))
    text = F.concat(F.lit("["), F.array_join(_let(F.array_sort(trimmed), counted), ","), F.lit("]"))
    return F.when(c.isNotNull() & valid, F.sha2(text, 256))


def truncate_text(c: Column, limit: int) -> Column:
    """At most ``limit`` characters; a cut text ends in three dots."""
    return F.when(F.length(c) > limit, F.concat(
        F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def text_chunks(c: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, cut at a paragraph, else a line, else anywhere.

    A paragraph or line break in the first half of a piece is not used.
    """
    def cut(text: str) -> list[str]:
        out, rest = [], text.strip()
        while len(rest) > limit:
            at = next((p for p in (rest.rfind(b, 0, limit) for b in ("\n\n", "\n"))
                       if p >= limit // 2), limit)
            out.append(rest[:at].rstrip())
            rest = rest[at:].lstrip()
        return out + [rest] if rest else out

    @F.arrow_udf(ArrayType(StringType()))
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            for at in range(0, len(values), SOME_ROWS):
                yield pa.array([None if v is None else cut(v) for v in values.slice(at, SOME_ROWS).to_pylist()],
                               pa.list_(pa.string()))
    return pieces(c)


def card_ids(json_text: Column) -> Column:
    """Distinct ``set-number`` ids under an id key anywhere in a JSON document, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(json_text, F.lit(
        r'"(?:id|card_id|target_card_id)"\s*:\s*"(\d+-\d+)"'), F.lit(1))))


def _unique_members(members: list[tuple]) -> dict:
    found = dict(members)
    if len(found) < len(members):
        raise ValueError("a name comes twice in an object")
    return found


def _no_constant(name: str):
    raise ValueError(name)


def _decoder() -> json.JSONDecoder:
    """Strict JSON; a zero with an exponent is not empty, as with Spark's variants."""
    return json.JSONDecoder(object_pairs_hook=_unique_members, parse_constant=_no_constant,
                            parse_float=lambda text: float(text) or "e" in text.lower())


def _id_names(decoder: json.JSONDecoder, body: str | None) -> set[tuple[str, str]]:
    """Pairs of one document; none if it is no JSON."""
    def text(node, *names):
        """The first of the members that is neither absent nor empty, if it is a text."""
        value = next((node[n] for n in names if node.get(n) and node[n] not in ("0", "false")), None)
        return value.encode("utf-8", "replace").decode() if isinstance(value, str) else None
    try:
        left = [decoder.raw_decode(body.lstrip(" \t\r\n"))[0]] if body else []
    except (ValueError, RecursionError):
        return set()
    found = set()
    while left:
        node = left.pop()
        if isinstance(node, dict):
            pair = text(node, "card_id", "id"), text(node, "card_name", "name")
            if pair[0] is not None and pair[1] is not None and pair[1].strip(" "):
                found.add(pair)
            node = node.values()
        if not isinstance(node, (str, int, float, type(None))):
            left += [x for x in node if isinstance(x, (dict, list))]
    return found


def id_name_pairs(docs: DataFrame, key: str, body: str) -> DataFrame:
    """Distinct (key, id, name) of every object, at any depth of a JSON document, that holds both.

    The id is under ``card_id`` or ``id``, the name under ``card_name`` or ``name``; both must be texts and the name not
    blank. A document is read once, a few at a time, and leaves its task as its distinct pairs.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder()
        for batch in batches:
            for at in range(0, batch.num_rows, SOME_ROWS):
                part = batch.slice(at, SOME_ROWS)
                found = [(i, *p) for i, text in enumerate(part.column(1).to_pylist()) for p in _id_names(decoder, text)]
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), *[pa.array([f[n] for f in found], pa.string()) for n in (1, 2)]],
                    names=[key, "id", "name"])
    some = docs.select(F.col(key), F.col(body).alias("_body"))
    schema = StructType([some.schema[0], StructField("id", StringType()), StructField("name", StringType())])
    return some.mapInArrow(pairs, schema).distinct()


def long_words(c: Column, shortest: int = 5) -> Column:
    """Distinct runs of at least ``shortest`` lower-case letters."""
    return F.array_distinct(F.regexp_extract_all(
        F.lower(c), F.lit("[a-z]{%d,}" % shortest), F.lit(0)))


def normalized_status(c) -> Column:
    """Upper-cased status without separators; NULL becomes empty."""
    return F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), "_- ", "")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of ``name`` in the namespace given as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    fixed = F.substring(variant, 1, 4).substr(F.pmod(nibble, F.lit(4)) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(fixed, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def request_allowed(body: Column, input_rate: float, output_rate: float, max_output: int, max_cost: float,
                    max_tokens: int = 272_000, framing: int = 1024) -> Column:
    """Whether a request stays within its cost and its bound of input tokens."""
    tokens = F.octet_length(body) + framing
    return (cost_bound(body, input_rate, output_rate, max_output, framing) <= max_cost) & (tokens <= max_tokens)


def cost_bound(body: Column, input_rate: float, output_rate: float, max_output: int,
               framing: int = 1024) -> Column:
    """Upper cost of a serialised request from its byte length; rates are per million."""
    tokens = F.octet_length(body) + framing
    return (tokens * F.lit(input_rate) + F.lit(max_output * output_rate)) / 1_000_000
