"""HTML removal, cleaning, clauses and tokens."""

from __future__ import annotations

import html.entities
import json
import re
import string
from typing import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from hearsay.functions.scalars import once

# Clause boundaries, and the characters a hot word must contain.
CLAUSE_REGEX = "[，。！？；：、\\.,!?;:\\n\\r\\t…~　\\s]+|[~～]+"
CJK_REGEX = "[一-鿿㐀-䶿]"

# The usual named character references; all others come from the standard library.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
    ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&middot;", "·"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&times;", "×"), ("&copy;", "©"), ("&reg;", "®"), ("&deg;", "°"), ("&yen;", "¥"),
]

_HIDDEN = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
# Whether there can be something that _HIDDEN takes out.
_HIDES = r"(?i)<(?:!--|script|style|template)"
# One tag at a time: a repeated group would recurse once per tag. Only single characters repeat.
# What no ">" ends is no tag but the rest of the text (group 1), which is then read only once.
_TAG = r"(<[a-zA-Z/!?][^>]*+\z)|<[a-zA-Z/!?][^>]*+>"
_SPACES = r"\s\x{0085}\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}"
_NODE = "\u0001"  # stands for one or more tags between two text nodes
_OPEN = "\u0003"  # stands for "<" where no tag or comment can end any more
_BOUNDARY = "\u0002"  # token that stands for a clause boundary
# Every character that is blank in Unicode.
_OTHER = r"\x{001c}-\x{001f}\x{1680}\x{202f}\x{205f}"  # blanks beside _SPACES
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_BLANK_ENDS = rf"\A[{_SPACES}{_OTHER}]|[{_SPACES}{_OTHER}]\z"
_LEGACY = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)


def _numeric(piece: Column) -> Column:
    """``#20013;`` and ``#x4e2d;`` as characters; an unknown code stays as it is."""
    def read(number: Column) -> Column:
        code = F.when(piece.startswith("#x"), F.conv(number, 16, 10)).when(
            number.rlike("^[0-9]++$"), number
        ).try_cast("bigint")
        return once(code, written)

    def written(code: Column) -> Column:
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.regexp_replace(piece, r"^#x?[0-9a-fA-F]++;", "")
        return F.when(valid, F.concat(char, rest)).otherwise(F.concat(F.lit("&"), piece))

    return once(F.regexp_extract(piece, r"^#(x?)([0-9a-fA-F]++);", 2), read)


def _named(piece: Column) -> Column:
    """``lt;`` and all other named references as characters, and the old names that need no
    semicolon; an unknown name stays as it is."""
    # A constant: it is folded to one map when the query is planned.
    known = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")
    size = F.char_length(piece)

    def whole(name: Column) -> Column:
        usual = F.lit(None).cast("string")
        for entity, char in [*ENTITIES, ("&amp;", "&")]:
            usual = F.when(name == entity[1:], char).otherwise(usual)
        found = F.coalesce(usual, F.when(name != "", F.try_element_at(known, name)))
        return F.concat(found, F.substring(piece, F.char_length(name) + 1, size))

    def old(short: Column) -> Column:
        found = F.when(short != "", F.try_element_at(known, short))
        return F.concat(found, F.substring(piece, F.char_length(short) + 1, size))

    return F.coalesce(
        once(F.regexp_extract(piece, r"^[a-zA-Z0-9]++;", 0), whole),
        once(F.regexp_extract(piece, "^(?:" + "|".join(_LEGACY) + ")", 0), old),
        F.concat(F.lit("&"), piece),
    )


def _decoded(text: Column) -> Column:
    """Character references decoded once, from left to right."""
    def decode(piece: Column, i: Column) -> Column:
        return F.when(i == 0, piece).when(piece.startswith("#"), _numeric(piece)).otherwise(
            _named(piece))

    # The text before the first "&" is no reference.
    return F.array_join(F.transform(F.split(text, "&"), decode), "")


def _last(text: Column, mark: str) -> Column:
    """The text up to its last ``mark``, included."""
    rest = F.substring_index(text, mark, -1)
    return F.left(text, F.char_length(text) - F.char_length(rest))


def _closed(text: Column, mark: str, opening: str) -> Column:
    """``opening`` made inert behind the last ``mark`` that could close it. A pattern that looks
    for the mark then always finds it, so its scans do not add up to the square of the text."""
    inert = F.lit(opening.replace("<", _OPEN))
    return once(text, lambda t: once(F.substring_index(t, mark, -1), lambda rest: F.concat(
        F.left(t, F.char_length(t) - F.char_length(rest)),
        F.replace(rest, F.lit(opening), inert))))


def _reopened(text: Column) -> Column:
    return F.replace(text, F.lit(_OPEN), F.lit("<"))


def _trimmed(text: Column) -> Column:
    """Without blanks at its ends; a look at the ends is cheaper than a search among all blanks."""
    return once(F.trim(text), lambda t: F.when(
        t.rlike(_BLANK_ENDS), F.trim(t, F.lit(_BLANKS))).otherwise(t))


def strip_html(text: Column, sep: str = " ", strip: bool = False) -> Column:
    """Text nodes joined by ``sep``; with ``strip`` they are trimmed and blank ones dropped.

    Text without '<' is returned as it is, NULL as ''.
    """
    def shown(source: Column) -> Column:
        # An unclosed comment is a tag up to the next ">"; behind the last ">" nothing is.
        shut = F.regexp_replace(
            _closed(_closed(source, ">", "<"), "-->", "<!--"), _HIDDEN, _NODE)
        return F.when(source.rlike(_HIDES), _closed(_reopened(shut), ">", "<")).otherwise(
            _reopened(source))

    def plain(source: Column) -> Column:
        nodes = _reopened(F.regexp_replace(shown(source), _TAG, f"$1{_NODE}"))
        if strip:
            # Blank nodes of a long text are joined first, so that few are split.
            few = once(nodes, lambda n: F.when(F.octet_length(n) > 1024, F.regexp_replace(
                n, f"{_NODE}[{_SPACES}{_NODE}]*+", _NODE)).otherwise(n))
            return F.array_join(F.filter(F.transform(
                F.split(few, _NODE), _trimmed), lambda n: n != ""), sep)
        nodes = F.trim(F.regexp_replace(nodes, f"{_NODE}++", _NODE), F.lit(_NODE))
        return F.replace(nodes, F.lit(_NODE), F.lit(sep))

    # Cheap tests of the source decide, so most texts take a short branch.
    return once(F.coalesce(text, F.lit("")), lambda source: F.when(
        ~source.contains("<"), source).otherwise(once(plain(source), lambda p: F.when(
            source.contains("&"), _decoded(p)).otherwise(p))))


def drop_tags(text: Column) -> Column:
    """Remove tags without putting anything in their place."""
    head = _last(text, ">")
    return F.concat(F.regexp_replace(head, "<[^>]+>", ""), F.substring_index(text, ">", -1))


def clean_text(text: Column) -> Column:
    """HTML removed, whitespace collapsed, trimmed."""
    return F.trim(F.regexp_replace(strip_html(text), f"[{_SPACES}]+", " "))


def clauses(text: Column, clause_regex: str = CLAUSE_REGEX) -> Column:
    """Non-empty clauses of a text."""
    return F.array_remove(F.split(text, clause_regex), "")


# A tokenizer maps a string column to an array of tokens.
Tokenizer = Callable[[Column], Column]


def regex_tokenizer(token_regex: str = r"\p{L}+", lower: bool = True) -> Tokenizer:
    """Tokens are the matches of a pattern; stays in the JVM."""
    def tokens(text: Column) -> Column:
        source = F.lower(text) if lower else text
        return F.regexp_extract_all(source, F.lit(f"({_BOUNDARY}|{token_regex})"), 1)
    return tokens


# Texts that a segmenter hands on together, and parts whose cuts a worker remembers.
TEXTS_AT_ONCE = 256
REMEMBERED, REMEMBERED_LENGTH = 200_000, 64


def _parts(words: Iterable[str], whole_runs: bool) -> str:
    """Pattern of the parts of a text that can be cut apart from each other: stretches of the
    characters of longer dictionary words (and of runs), and every other character alone."""
    inner = {c for w in words if len(w) > 1 for c in w}
    if whole_runs:
        inner |= set(string.ascii_letters + string.digits)
    kept = "".join(re.escape(c) for c in sorted(inner))
    return f"[{kept}]+|[^{kept}]" if inner else "(?s:.)"


def _segmenter(cut: Callable[..., list[str]], shared: Broadcast) -> Tokenizer:
    """Tokenizer that cuts parts of texts with ``cut(part, *values)``; the values, and the
    pattern of the parts, are broadcast. A part that was met before is not cut again, and tokens
    leave the worker after a few texts, so its memory does not grow with the batch."""
    @F.arrow_udf(ArrayType(StringType()))
    def segment(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pattern, *values = shared.value
        parts, known = re.compile(pattern), {}

        def tokens(text: str | None) -> list[str] | None:
            if text is None:
                return None
            out = []
            for part in parts.findall(text):
                if len(part) == 1:
                    out.append(part)
                    continue
                found = known.get(part)
                if found is None:
                    found = cut(part, *values)
                    if len(part) <= REMEMBERED_LENGTH:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[part] = found
                out += found
            return out

        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                texts = batch.slice(at, TEXTS_AT_ONCE).to_pylist()
                yield pa.array(map(tokens, texts), pa.list_(pa.string()))

    return segment


def max_match_tokenizer(
    spark: SparkSession, words: Iterable[str], max_words: int = 1_000_000,
    whole_runs: bool = True,
) -> Tokenizer:
    """Longest dictionary word first, for text without spaces.

    Runs of ASCII letters or digits stay together unless ``whole_runs`` is False, other characters
    stand alone. The word list is broadcast, so its length is checked; a larger dictionary is
    refused.
    """
    vocabulary = frozenset(words)
    if len(vocabulary) > max_words:
        raise ValueError(f"{len(vocabulary)} words exceed the broadcast bound of {max_words}")
    shared = spark.sparkContext.broadcast((
        _parts(vocabulary, whole_runs), vocabulary, max((len(w) for w in vocabulary), default=1)))

    def cut(text: str, known: frozenset, longest: int) -> list[str]:
        out, i, n = [], 0, len(text)
        while i < n:
            end = i + 1
            if whole_runs and text[i].isascii() and text[i].isalnum():
                while end < n and text[end].isascii() and text[end].isalnum():
                    end += 1
            for j in range(min(n, i + longest), end, -1):
                if text[i:j] in known:
                    end = j
                    break
            out.append(text[i:end])
            i = end
        return out

    return _segmenter(cut, shared)


# A word's cost is its negative log-likelihood in millionths, a whole number, so that equal paths
# are equal on every machine.
COST_UNIT = 1_000_000


def word_costs(frequencies: DataFrame) -> DataFrame:
    """Costs (word, cost) of a frequency table (word, n): the rarer, the dearer. Words met again
    are summed; words without characters, and counts below one, are left out."""
    n = frequencies.where((F.col("word") != "") & (F.col("n") > 0)).groupBy("word").agg(
        F.sum("n").alias("n"))
    total = F.lit(n.agg(F.sum("n")).first()[0] or 1)

    def cost(count: Column) -> Column:
        return F.round(F.ln(total / count) * COST_UNIT).cast("bigint")

    return n.select("word", cost(F.col("n")).alias("cost"), cost(F.lit(1)).alias("unknown"))


def best_path_tokenizer(
    spark: SparkSession, frequencies: DataFrame, max_words: int = 1_000_000,
    whole_runs: bool = True,
) -> Tokenizer:
    """The most likely words of a text without spaces, given a frequency table (word, n).

    All dictionary words at all places make a word graph; the path with the least total cost wins,
    of equal ones that with the longer first word. A character that is no word costs as much as a
    word met once. Runs of ASCII letters or digits stay together unless ``whole_runs`` is False.
    The table is broadcast, so its length is checked; a larger one is refused. Time grows with the
    text times the longest word.
    """
    rows = word_costs(frequencies).limit(max_words + 1).collect()  # bounded
    if len(rows) > max_words:
        raise ValueError(f"the dictionary exceeds the broadcast bound of {max_words} words")
    costs = {r.word: r.cost for r in rows}
    begins = {w[:k] for w in costs for k in range(1, len(w))}
    shared = spark.sparkContext.broadcast(
        (_parts(costs, whole_runs), costs, begins, rows[0].unknown if rows else 0))

    def cut(text: str, costs: dict, begins: set, unknown: int) -> list[str]:
        n = len(text)
        best, size = [0] * (n + 1), [1] * n
        run = n  # end of the run of ASCII letters or digits that holds the place
        for i in range(n - 1, -1, -1):
            if whole_runs and text[i].isascii() and text[i].isalnum():
                if i + 1 == n or not (text[i + 1].isascii() and text[i + 1].isalnum()):
                    run = i + 1
                # A run is a word of its own; the path goes on behind it.
                best[i], size[i] = best[run], run - i
                continue
            least, j = None, i + 1
            while j <= n:
                word = text[i:j]
                cost = costs.get(word, unknown if j == i + 1 else None)
                if cost is not None and (least is None or cost + best[j] <= least):
                    least, size[i] = cost + best[j], j - i
                if word not in begins:
                    break
                j += 1
            best[i] = least
        out, i = [], 0
        while i < n:
            out.append(text[i : i + size[i]])
            i += size[i]
        return out

    return _segmenter(cut, shared)


def tokens_with_boundaries(
    text: Column, tokenizer: Tokenizer, clause_regex: str, gap: int
) -> Column:
    """Tokens of a whole text with ``gap`` boundary tokens between clauses, so a window of
    ``gap`` tokens cannot reach into another clause."""
    mark = f" {_BOUNDARY}" * gap + " "
    return tokenizer(F.regexp_replace(text, clause_regex, mark))


def is_word(token: Column, must_contain: str = CJK_REGEX, min_length: int = 2) -> Column:
    """Whether a token counts as a word: long enough, and with a required character."""
    return (F.char_length(token) >= min_length) & token.rlike(must_contain)
