"""Text features as column expressions: words, ratios, sentences, boilerplate, density, paragraphs.

All run inside the JVM. White space is Unicode white space. A null text gives null from every
function here except counts, which are 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lexicon of the density score, matched as substrings.
LEXICON = [
    "carbone", "co2", "émission", "émissions", "climat", "climatique", "environnement", "environnemental", "biodiversité", "déchets",
    "énergie renouvelable", "transition énergétique", "scope", "neutralité carbone", "net zéro", "empreinte", "pollution",
    "emploi", "salarié", "salariés", "diversité", "égalité", "formation", "santé", "sécurité", "accident", "absentéisme",
    "parité", "handicap", "inclusion", "conditions de travail",
    "conseil d'administration", "rémunération", "audit", "risque", "conformité", "éthique", "corruption", "déontologie",
    "gouvernance", "comité", "indépendant",
    "matérialité", "matériel", "esrs", "csrd", "dpef", "extra-financier", "enjeux", "parties prenantes", "impact", "double matérialité",
    "taxonomie", "reporting durabilité", "indicateur",
    "résultat", "chiffre d'affaires", "ebitda", "dette", "trésorerie", "dividende", "acquisition", "cession",
    "investissement", "marge", "rentabilité",
]
# Shapes of structural fragments, on trimmed lower-case text.
STRUCTURAL = [
    r"^page\s+\d+\s+(sur|of|/)\s+\d+$",
    r"^(suite|voir|cf\.?|ibid|op\.?\s*cit)\b",
    r"^\s*\d+\s*$",
    r"^(tableau|figure|graphique|annexe)\s+\d+",
    r"^\s*[\[\(].*[\]\)]\s*$",
]
# Bounds of the quality filter.
MIN_ALPHA, MIN_UNIQUE, MIN_WORDS, MAX_WORDS, MIN_SENTENCES = 0.55, 0.30, 20, 340, 2
# Bounds of extracted paragraphs, in words, and the shapes that close a block.
PARAGRAPH_MIN, PARAGRAPH_MAX = 15, 350
SENTENCE_END = r"[.!?;:»]\s*$"
HEADER_LINE = r"^[A-ZÉÈÊÀÙÎÔÂÛÏË\d\s\-–—/&]{4,}$"


#: Unicode white space: its characters, and a class of them for the JVM's patterns.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def bare(c: Column) -> Column:
    """Without outer white space."""
    return F.btrim(c, F.lit(BLANKS))


def word_array(c: Column) -> Column:
    """Words between white space; an empty array for blank text."""
    return F.array_remove(F.split(c, SPACE + "+"), "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(word_array(c)), F.lit(0)).cast("long")


def alpha_ratio(c: Column) -> Column:
    """Letters by code points; 0 for empty text."""
    return F.when(F.length(c) > 0, (F.length(c) - F.length(F.regexp_replace(c, r"\p{L}+", ""))) / F.length(c)).when(c.isNotNull(), 0.0)


def _distinct_ratio(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).when(words.isNotNull(), 0.0)


def unique_ratio(c: Column) -> Column:
    """Distinct words in lower case by words; 0 for blank text."""
    return let(word_array(F.lower(c)), _distinct_ratio)


def sentence_count(c: Column) -> Column:
    """Parts between runs of sentence marks; an empty part at the end counts."""
    return F.size(F.split(c, "[.!?;]+")).cast("long")


def _structural(low: Column) -> Column:
    return bare(low).rlike("(?U)^(?:" + "|".join(p.removeprefix("^") for p in STRUCTURAL) + ")")


def is_structural(c: Column) -> Column:
    return _structural(F.lower(c))


def measures(c: Column) -> Column:
    """All features of a text as one struct: n_words, alpha_ratio, unique_ratio, n_sentences and
    structural. The text is put in lower case and taken apart into words once."""

    def of(low: Column, words: Column) -> Column:
        return F.struct(
            F.coalesce(F.size(words), F.lit(0)).cast("long").alias("n_words"),
            alpha_ratio(c).alias("alpha_ratio"),
            _distinct_ratio(words).alias("unique_ratio"),
            sentence_count(c).alias("n_sentences"),
            _structural(low).alias("structural"),
        )

    return let(F.lower(c), lambda low: let(word_array(low), lambda words: of(low, words)))


def _quality(c: Column, low: Column, words: Column) -> Column:
    """The cheap conditions first, as the first that fails ends the evaluation."""
    n = F.size(words)
    ok = n.between(MIN_WORDS, MAX_WORDS) & ~_structural(low) & (sentence_count(c) >= MIN_SENTENCES)
    return F.coalesce(ok & (_distinct_ratio(words) >= MIN_UNIQUE) & (alpha_ratio(c) >= MIN_ALPHA), F.lit(False))


def passes_quality(c: Column) -> Column:
    """The conjunction of the six mechanical filters; null text does not pass."""
    return let(F.lower(c), lambda low: let(word_array(low), lambda words: _quality(c, low, words)))


def _density(low: Column, n_words: Column, lexicon: list[str]) -> Column:
    hits = sum((F.when(F.contains(low, F.lit(k)), 1).otherwise(0) for k in lexicon), F.lit(0))
    return F.round(hits / F.greatest(n_words, F.lit(1)), 6)


def scored(c: Column, quality: bool = True, lexicon: list[str] | None = None) -> Column:
    """Struct of n_words and density of a text that passes the quality filter, else null; of every
    text with ``quality`` off."""

    def of(low: Column, words: Column) -> Column:
        n = F.coalesce(F.size(words), F.lit(0)).cast("long")
        got = F.struct(n.alias("n_words"), _density(F.coalesce(low, F.lit("")), n, lexicon or LEXICON).alias("density"))
        return F.when(_quality(c, low, words), got) if quality else got

    return let(F.lower(c), lambda low: let(word_array(low), lambda words: of(low, words)))


def density(c: Column, lexicon: list[str] | None = None) -> Column:
    """Terms of the lexicon present as substrings by words, to 6 places; 0 for null text."""
    return let(F.lower(F.coalesce(c, F.lit(""))), lambda low: _density(low, F.size(word_array(low)).cast("long"), lexicon or LEXICON))


def quartile_label(score: Column, cuts: Column) -> Column:
    """q0_low to q3_high by the three thresholds in the array ``cuts``."""
    return F.when(score <= cuts[0], "q0_low").when(score <= cuts[1], "q1_med_low").when(score <= cuts[2], "q2_med_high").when(score.isNotNull(), "q3_high")


def stratum_id(bucket: Column, group: Column, quartile: Column) -> Column:
    return F.concat_ws("__", bucket, F.substring(F.regexp_replace(group, "[^a-zA-Z0-9_]", "_"), 1, 30), quartile)


def content_id(c: Column) -> Column:
    """The first 32 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 32)


def signature(c: Column, n: int = 80) -> Column:
    """The first n characters of trimmed text."""
    return F.substring(bare(c), 1, n)


def rebuild_blocks(c: Column) -> Column:
    """Blocks of line-wrapped text: a blank line, a short upper-case header and a short line that
    ends a sentence close a block; headers are blocks of their own. One fold over the lines."""
    lines = F.transform(F.split(c, "\n"), bare)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def close(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(F.split(x, r"(?U)\s+"))
        head = (n <= 8) & x.rlike(HEADER_LINE.replace(r"\d\s", r"\p{Nd}\s"))
        grown = F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit(" "), x))
        ends = (n <= 15) & x.rlike(SENTENCE_END)
        return (
            F.when(x == "", F.struct(close(acc).alias("done"), F.lit("").alias("open")))
            .when(head, F.struct(F.array_append(close(acc), x).alias("done"), F.lit("").alias("open")))
            .when(ends, F.struct(F.array_append(acc["done"], grown).alias("done"), F.lit("").alias("open")))
            .otherwise(F.struct(acc["done"].alias("done"), grown.alias("open")))
        )

    return F.aggregate(lines, zero, step, close)


def split_blocks(c: Column) -> Column:
    """Paragraphs between blank lines, with runs of spaces squeezed; single lines if there is none."""
    tidy = F.filter(F.transform(F.split(c, r"\n{2,}"), bare), lambda x: x != "")
    lines = F.filter(F.transform(F.split(c, r"\n"), bare), lambda x: x != "")
    return F.transform(F.when(F.size(tidy) > 0, tidy).otherwise(lines), lambda x: F.regexp_replace(x, " {2,}", " "))


def pack_sentences(block: Column, most: int = PARAGRAPH_MAX, least: int = PARAGRAPH_MIN) -> Column:
    """A block in chunks of whole sentences of at most ``most`` words; chunks of fewer than
    ``least`` are left out, a longer single sentence stays whole. One fold over the sentences."""
    parts = F.split(block, r"(?<=[.!?])\s+")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).cast("long").alias("n"))

    def close(done: Column, cur: Column) -> Column:
        chunk = bare(F.array_join(cur, " "))
        return F.when(word_count(chunk) >= least, F.array_append(done, chunk)).otherwise(done)

    def step(acc: Column, x: Column) -> Column:
        n = word_count(x)
        return F.when(acc["n"] + n <= most, F.struct(acc["done"].alias("done"), F.array_append(acc["cur"], x).alias("cur"), (acc["n"] + n).alias("n"))).otherwise(
            F.struct(close(acc["done"], acc["cur"]).alias("done"), F.array(x).alias("cur"), n.alias("n"))
        )

    return F.aggregate(parts, zero, step, lambda acc: close(acc["done"], acc["cur"]))


def paragraphs(c: Column, wrapped: bool = False) -> Column:
    """Extracted paragraphs of ``PARAGRAPH_MIN`` to ``PARAGRAPH_MAX`` words; longer ones packed."""
    blocks = split_blocks(F.array_join(rebuild_blocks(c), "\n\n") if wrapped else c)
    keep = lambda p: F.when(word_count(p) > PARAGRAPH_MAX, pack_sentences(p)).when(word_count(p) >= PARAGRAPH_MIN, F.array(p)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(blocks, keep))


# Elements that hold no text, and elements that end a line.
BOILERPLATE_TAGS = ["script", "style", "nav", "footer", "header", "aside", "form", "noscript"]
BLOCK_TAGS = ["p", "br", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr"]


def html_text(c: Column) -> Column:
    """Text of an HTML page: boilerplate elements dropped, a line end after block elements, other
    tags removed, runs of blanks squeezed."""
    t = c
    for tag in BOILERPLATE_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, rf"(?i)</?({'|'.join(BLOCK_TAGS)})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return bare(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def page_text(c: Column, least: int = 100) -> Column:
    """Text of a page if it is longer than ``least`` characters, else null."""
    return let(html_text(c), lambda t: F.when(F.length(t) > least, t))


def error_key(c: Column) -> Column:
    """The stable head of an error message: what stands before " :" and " doit"."""
    return bare(F.split(F.split(c, " :")[0], " doit")[0])


def prompt(company: Column, year: Column, content: Column) -> Column:
    """The annotation prompt of a paragraph: company, year (or the whole span), 600 characters."""
    when = F.when(year > 0, year.cast("string")).otherwise("2010-2026")
    return F.concat(F.lit("Société : "), F.coalesce(company, F.lit("Inconnue")), F.lit(" | Année : "), when, F.lit("\nExtrait : «"), F.substring(F.coalesce(content, F.lit("")), 1, 600), F.lit("»"))


def n_shot(examples: DataFrame, place: str, content: str, answer: str) -> DataFrame:
    """One row with the examples of a prompt in order, and how many they are."""
    line = F.concat(F.lit("Exemple "), F.col(place).cast("string"), F.lit(" :\nExtrait : «"), F.coalesce(F.col(content), F.lit("")), F.lit("»\nRéponse : "), F.col(answer))
    rows = F.array_sort(F.collect_list(F.struct(F.col(place).alias("k"), line.alias("x"))))
    return examples.agg(F.array_join(F.transform(rows, lambda r: r["x"]), "\n\n").alias("prompt"), F.count("*").alias("n"))


def chat(system: Column, user: Column) -> Column:
    """An instruction turn with a system part."""
    return F.concat(F.lit("<s>[INST] "), system, F.lit("\n\n"), user, F.lit(" [/INST]"))
