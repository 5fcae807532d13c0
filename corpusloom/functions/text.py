"""Text expressions: splitting, packing, counting, fitting, normalising.

Everything but Unicode normalisation is a JVM-side expression.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.schemas import ChunkOptions


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_sentences(text: Column | str) -> Column:
    return _stripped(F.split(_col(text), r"(?U)(?<=[.!?])\s+", -1))


def split_paragraphs(text: Column | str) -> Column:
    return _stripped(F.split(_col(text), r"\n{2,}", -1))


def split_lines(text: Column | str) -> Column:
    return _stripped(F.split(_col(text), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1))


def words(text: Column | str) -> Column:
    """Unicode white-space words."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?U)\S+"), F.lit(0))


def pack(parts: Column, size: int, overlap: int) -> Column:
    """Greedy packing of parts into chunks of about ``size`` characters.

    A part that does not fit starts the next chunk and is never cut.  Each
    chunk but the first is led by the last ``overlap`` characters of the
    finished chunk before it.
    """
    empty = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, p: Column) -> Column:
        fits = F.length(a["buf"]) + F.length(p) + 1 <= size
        joined = F.when(a["buf"] == "", p).otherwise(F.concat(a["buf"], F.lit(" "), p))
        out = F.when(fits | (a["buf"] == ""), a["out"]).otherwise(F.array_append(a["out"], a["buf"]))
        return F.struct(F.when(fits, joined).otherwise(p).alias("buf"), out.alias("out"))

    chunks = F.aggregate(parts, empty, add, lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.array_append(a["out"], a["buf"])))
    if isinstance(overlap, int) and overlap <= 0:
        return chunks

    def lead(out: Column, c: Column) -> Column:
        last = F.element_at(out, -1)
        tail = F.when(F.length(last) > overlap, F.right(last, F.lit(overlap))).otherwise(last)
        return F.array_append(out, F.when(F.size(out) == 0, c).otherwise(strip(F.concat(tail, F.lit(" "), c))))

    return F.aggregate(chunks, F.array().cast("array<string>"), lead)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_chars(text: Column | str, size: int, overlap: int) -> Column:
    t, step = _col(text), F.greatest(F.lit(1), F.lit(size) - F.lit(overlap))
    at = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return _stripped(F.transform(at, lambda i: F.substring(t, i + 1, F.lit(size))))


def split_words(text: Column | str, size: int, overlap: int) -> Column:
    """Windows of ``size`` words; each starts ``overlap`` words before the end of the last."""
    step = size - overlap

    def cut(w: Column) -> Column:
        n = F.size(w)
        count = F.when(n <= size, F.least(n, F.lit(1))).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
        at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))

    return bound(words(text), cut)


def split_recursive(text: Column | str, size: int, overlap: int, separators: tuple[str, ...]) -> Column:
    """Split at one separator after the other until the mean piece is at most 1.2 sizes long."""

    def step(sep: str):
        literal = "\\Q" + sep + "\\E"

        def split(s: Column) -> Column:
            parts = F.filter(F.flatten(F.transform(s["pieces"], lambda p: F.split(p, literal, -1))), lambda p: p != "")
            return F.when(s["done"], s["pieces"]).otherwise(parts)

        def judge(s: Column, pieces: Column) -> Column:
            total = F.aggregate(pieces, F.lit(0), lambda a, p: a + F.length(p))
            return F.struct(pieces.alias("pieces"), (s["done"] | (total / F.greatest(F.size(pieces), F.lit(1)) <= size * 1.2)).alias("done"))

        return lambda s: bound(split(s), lambda pieces: judge(s, pieces))

    state = F.struct(F.filter(F.array(_col(text)), lambda p: p != "").alias("pieces"), F.lit(False).alias("done"))
    for sep in separators:
        state = bound(state, step(sep))
    return bound(_stripped(state["pieces"]), lambda pieces: pack(pieces, size, overlap))


# Limits and options of the suggested strategies.
TABLE_LINE, MANY_BULLETS, MANY_LINES, SHORT_TEXT = 40, 10, 20, 2000
PARAGRAPH_SIZES, PARAGRAPH_OVERLAP = (400, 1000), 100
SENTENCE_OPTIONS, RECURSIVE_OPTIONS = (600, 120), (800, 150)


def suggest(text: Column | str) -> Column:
    """Strategy, size and overlap from the look of a text."""
    t = _col(text)
    count = lambda s: (F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s)
    lines, n = count("\n"), F.length(t)
    table = t.contains("|") | (t.contains(",") & t.contains("\n") & (n / (lines + 1) > TABLE_LINE))
    option = lambda s, size, ov: F.struct(F.lit(s).alias("strategy"), size.cast("int").alias("size"), F.lit(ov).alias("overlap"))
    paragraph = option("paragraph", F.least(F.lit(PARAGRAPH_SIZES[1]), F.greatest(F.lit(PARAGRAPH_SIZES[0]), F.floor(n / 50))), PARAGRAPH_OVERLAP)
    return F.when(table | (count("•") + count("- ") > MANY_BULLETS) | (lines > MANY_LINES), paragraph).when(n < SHORT_TEXT, option("sentence", F.lit(SENTENCE_OPTIONS[0]), SENTENCE_OPTIONS[1])).otherwise(option("recursive", F.lit(RECURSIVE_OPTIONS[0]), RECURSIVE_OPTIONS[1]))


def chunks(text: Column | str, o: ChunkOptions) -> Column:
    """Chunks of a text by the strategy of ``o``; unknown strategies mean sentences."""
    match o.strategy:
        case "char":
            return split_chars(text, o.size, o.overlap)
        case "word" | "tokens":
            return split_words(text, o.size, o.overlap)
        case "paragraph":
            return pack(split_paragraphs(text), o.size, o.overlap)
        case "line":
            return pack(split_lines(text), o.size, o.overlap)
        case "recursive":
            return split_recursive(text, o.size, o.overlap, o.separators)
        case _:
            return pack(split_sentences(text), o.size, o.overlap)


# Bounds of options that a model proposes, and the preview it sees.
LEAST_SIZE, PREVIEW = 100, 4000
STRATEGIES = ["char", "word", "sentence", "paragraph", "line", "recursive", "tokens"]


def model_options(reply: Column | str, text: Column | str, default: ChunkOptions | None = None) -> Column:
    """Options in a model's reply, kept within bounds; without a usable one those that the text suggests."""
    o = default or ChunkOptions()
    raw = F.regexp_extract(_col(reply), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(raw, "strategy STRING, size INT, overlap INT")
    named = F.lower(F.coalesce(parsed["strategy"], F.lit("sentence")))
    strategy = F.when(named.isin(STRATEGIES), named).otherwise(F.lit("sentence"))
    size, overlap = F.greatest(F.lit(LEAST_SIZE), F.coalesce(parsed["size"], F.lit(o.size))), F.greatest(F.lit(0), F.coalesce(parsed["overlap"], F.lit(o.overlap)))
    usable = F.coalesce(parsed["strategy"].isNotNull() | parsed["size"].isNotNull() | parsed["overlap"].isNotNull(), F.lit(False))
    return F.when(usable, F.struct(strategy.alias("strategy"), size.alias("size"), overlap.alias("overlap"))).otherwise(suggest(text))


def chunks_by(text: Column | str, options: Column, separators: tuple[str, ...] = ChunkOptions.separators) -> Column:
    """Chunks of each text by its own options (strategy, size, overlap)."""

    def cut(s: Column) -> Column:
        t, size = _col(text), s["size"]
        overlap = F.when(s["strategy"].isin("word", "tokens", "char"), F.least(s["overlap"], size - 1)).otherwise(s["overlap"])  # a window must move on
        out = pack(split_sentences(t), size, overlap)
        for name, made in (("char", split_chars(t, size, overlap)), ("word", split_words(t, size, overlap)), ("tokens", split_words(t, size, overlap)), ("paragraph", pack(split_paragraphs(t), size, overlap)), ("line", pack(split_lines(t), size, overlap)), ("recursive", split_recursive(t, size, overlap, separators))):
            out = F.when(s["strategy"] == name, made).otherwise(out)
        return out

    return bound(options, cut)


def chunks_suggested(text: Column | str, separators: tuple[str, ...] = ChunkOptions.separators) -> Column:
    """Chunks by the options that :func:`suggest` picks for each text on its own."""
    t = _col(text)
    s = suggest(t)
    # The paragraph size depends on the text; the fold takes it as a column.
    return F.when(s["strategy"] == "sentence", pack(split_sentences(t), *SENTENCE_OPTIONS)).when(s["strategy"] == "recursive", split_recursive(t, *RECURSIVE_OPTIONS, separators)).otherwise(pack(split_paragraphs(t), s["size"], PARAGRAPH_OVERLAP))


def approx_tokens(text: Column | str, ratio: float = 1.33) -> Column:
    t = _col(text)
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(F.floor(F.size(words(t)) * F.lit(ratio)).cast("int") + 1)


#: Words to tokens, by provider.
RATIOS = {"gemini": 2.0, "openai": 1.33, "azure": 1.33}


def count_tokens(text: Column | str, provider: str = "") -> Column:
    return approx_tokens(text, RATIOS.get(provider, 1.5))


def fit(text: Column | str, max_tokens: int) -> Column:
    """The text, or its first sentences that fit the budget, or a cut if the first does not."""
    t = _col(text)
    if max_tokens <= 0:
        return F.lit("")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("words"), F.lit(False).alias("done"))

    def add(a: Column, s: Column) -> Column:
        n = a["words"] + F.size(words(s))
        over = a["done"] | (F.floor(n * F.lit(1.33)) + 1 > max_tokens)
        kept = F.when(over, a["kept"]).when(a["kept"] == "", s).otherwise(F.concat(a["kept"], F.lit(" "), s))
        return F.struct(kept.alias("kept"), F.when(over, a["words"]).otherwise(n).alias("words"), over.alias("done"))

    kept = F.aggregate(F.split(t, r"(?<=[.!?]) +", -1), start, add, lambda a: a["kept"])
    cut = F.when(kept == "", F.substring(t, 1, int(max_tokens * 4 * 0.9))).otherwise(kept)
    return F.when(t.isNull() | (t == ""), F.lit("")).when(approx_tokens(t) <= max_tokens, t).otherwise(cut)


def normalize(compat: bool = False):
    """Pandas UDF: printable NFKC text with squeezed blanks.

    Line breaks are kept for the rules that need them; ``compat`` drops every
    non-printable character first, line breaks included.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(s: str | None) -> str | None:
            if s is None:
                return None
            s = "".join(c for c in s if c.isprintable() or (not compat and c in "\n\r\t\xa0"))
            s = unicodedata.normalize("NFKC", s)
            return s

        return texts.map(one)

    return lambda text: strip(
        F.regexp_replace(
            F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(run(_col(text)), r"\r\n?", "\n"), r"(\w)-\n(\w)", "$1$2"), r"[ \t]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n"
        )
    )


def is_too_sparse(text: Column | str, threshold: int = 60) -> Column:
    return F.length(strip(F.regexp_replace(_col(text), r"\s+", " "))) < threshold


# Patterns of prices, areas and unit counts; letters match in either case.
PRICE = r"(\d[\d\s.,]*)\s*(MDH|MAD|DHS|Dh|Dhs|dirhams?)"
AREA = r"(\d+(?:[.,]\d+)?)\s*m²|\b(\d+(?:[.,]\d+)?)\s*m2"
UNITS = r"(\d+)\s*(villas?|appartements?|appartement|villes?)"


#: Frequent short words of the languages that are told apart, none of them shared.
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "is", "with", "this", "that"],
    "fr": ["les", "et", "une", "dans", "est", "pour", "avec", "sur"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "ein"],
    "es": ["el", "los", "y", "que", "las", "por", "con", "una"],
}


def detect_language(text: Column | str, preview: int = 2000) -> Column:
    """Language whose stop words are most frequent at the beginning of a text, the first by name among equals; null without any."""
    found = F.split(F.lower(F.substring(_col(text), 1, preview)), r"[^\p{L}]+", -1)

    def vote(w: Column) -> Column:
        votes = [F.struct((-F.size(F.filter(w, _in(words)))).alias("n"), F.lit(lang).alias("lang")) for lang, words in sorted(STOP_WORDS.items())]
        best = F.least(*votes)
        return F.when(best["n"] < 0, best["lang"])

    return bound(found, vote)


def _in(words: list[str]):
    return lambda x: x.isin(words)


def facts(text: Column | str) -> Column:
    """Price in dirhams, area in square metres and unit counts named in a text."""
    t = F.regexp_replace(_col(text), r"\s+", " ")
    price, area, units = (f"(?i){p}" for p in (PRICE, AREA, UNITS))
    raw = F.regexp_replace(F.replace(F.regexp_extract(t, price, 1), F.lit(","), F.lit(".")), r"[^\d.]", "")
    amount = F.expr("try_cast(1 AS double)") * raw.try_cast("double")
    millions = F.upper(F.regexp_extract(t, price, 2)) == "MDH"
    some = lambda x: F.nullif(x, F.lit(""))
    return F.struct(
        F.round(F.when(millions, amount * 1_000_000).otherwise(amount)).cast("bigint").alias("price_from_mad"),
        F.replace(F.concat(F.regexp_extract(t, area, 1), F.regexp_extract(t, area, 2)), F.lit(","), F.lit(".")).try_cast("double").alias("area_m2"),
        F.regexp_extract(t, units, 1).try_cast("int").alias("units_count"),
        F.lower(some(F.regexp_extract(t, units, 2))).alias("units_label"),
    )


def parse_ranges(spec: Column | str) -> Column:
    """"1,2,5-8,10-" as sorted distinct numbers; an open end is its start, an open start is ignored."""
    parts = F.transform(F.split(_col(spec), ",", -1), strip)
    good = F.filter(parts, lambda p: p.rlike(r"^\d+(\s*-\s*\d*)?$"))

    def one(p: Column) -> Column:
        lo = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
        hi = F.coalesce(F.regexp_extract(p, r"-\s*(\d+)$", 1).try_cast("int"), lo)
        return F.when(hi >= lo, F.sequence(lo, hi, F.lit(1))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(good, one))))
