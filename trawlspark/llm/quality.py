"""Quality rules: word and line counts, and the divergence of a document from its language.

Every document gets exact counts (words, symbols, repeated lines, words in repeated windows) and two
histograms: character classes, and common words. Each language's reference is the sum of the
histograms of all documents labelled with it. A document is rejected when it is too short or too
repetitive (base rules), or when its Jensen-Shannon distance to the nearest reference exceeds a bound.
Short documents have noisy histograms, so each distance counts only from a minimum length on.

Everything is built-in column expressions: no Python runs on the executors. Counting is one pass over
the texts without a shuffle; references are one small aggregate, embedded as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlspark.llm.stage import written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Up to so many repeated windows are looked up one by one.
FEW = 32

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that it for was on with as by at be this are have not "
    "der die das und ist von mit sich nicht eine ein auf für dem den zu "
    "le la les de des et en que un une du pour dans qui est par "
    "el los las y por con para una del se no su al como más"
).split()

# Character classes, taken one after the other from what the earlier ones left.
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", SPACE),
    ("upper", "[A-Z]+"),
    ("letter", r"\p{L}+"),
    ("digit", "[0-9]+"),
    ("stop", "[.,;:!?'\"()-]+"),
    ("symbol", "[#*$%&|<>]+"),
)

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Jensen-Shannon distances (0 to 1) beyond which a document is not of any reference language.
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.32
#: Lengths from which the two distances count.
MIN_CLASS_CHARS = 300
MIN_COMMON_WORDS = 80
#: A language with this share of all labelled words is a reference for all documents, one with less
#: for the documents labelled with it.
MIN_REFERENCE_SHARE = 0.001


def _distinct_words() -> list[str]:
    return list(dict.fromkeys(COMMON_WORDS))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the arrays q_classes
    (characters per class, the rest last) and q_words (occurrences per common word, other words last).

    A null text counts as empty: all counts are 0. Columns of these names in docs are replaced.
    """
    out = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    left, sizes = "__t", []
    for name, pattern in CLASSES:
        out = out.withColumn(f"__r_{name}", F.regexp_replace(left, pattern, ""))
        sizes.append((F.length(left) - F.length(f"__r_{name}")).cast("long"))
        left = f"__r_{name}"
    sizes.append(F.length(left).cast("long"))
    out = out.withColumn("__lines", lines).withColumn("q_classes", F.array(*sizes))
    # each common word becomes one character, so that a histogram is a few string replacements
    words = _distinct_words()
    codes = [chr(0x100 + i) for i in range(len(words))]
    written_as = {form: code for w, code in zip(words, codes, strict=True) for form in (w, w.capitalize())}
    table = F.create_map(*[F.lit(x) for pair in written_as.items() for x in pair])
    known = F.filter("__w", lambda w: w.isin(list(written_as)))
    out = out.withColumn("__c", F.array_join(F.transform(known, lambda w: F.element_at(table, w)), ""))
    found = [(F.length("__c") - F.length(F.replace("__c", F.lit(c), F.lit("")))).cast("long") for c in codes]
    n_words = F.size("__w").cast("long")
    out = out.withColumn("q_words", F.array(*found, n_words - F.length("__c")))
    out = out.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w))).withColumn("__k", _windows("__h"))
    return out.withColumns(
        {
            "n_words": n_words,
            "word_chars": (F.length("__t") - F.col("q_classes")[1]).cast("long"),
            "n_symbols": F.col("q_classes")[len(CLASSES) - 1],
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(
                F.size(F.array_distinct("__k")) < F.size("__k"), _covered("__k")
            ).otherwise(F.lit(0)).cast("long"),
        }
    ).drop("__t", "__w", "__lines", "__c", "__h", "__k", *[f"__r_{name}" for name, _ in CLASSES])


def _windows(words: str) -> Column:
    """Hash of each window of WINDOW (hashed) words, in order."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.transform(
        starts, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, WINDOW)])
    )


def _covered(keys: str) -> Column:
    """Words covered by windows whose hash occurs twice or more; n log n for any text.

    With few repeated hashes their windows are looked up; else windows are sorted with their places.
    One-element arrays name an intermediate value, so that it is made once a row.
    """
    ordered = F.transform(
        F.array(F.sort_array(keys)),
        lambda s: F.array_distinct(F.filter(s, lambda k, j: F.get(s, j + 1).eqNullSafe(k))),
    )
    pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def same(pairs: Column, j: Column, x: Column) -> Column:
        return F.get(pairs, j + 1)["k"].eqNullSafe(x["k"]) | F.get(pairs, j - 1)["k"].eqNullSafe(x["k"])

    def places(pairs: Column) -> Column:
        return F.array_sort(F.transform(F.filter(pairs, lambda x, j: same(pairs, j, x)), lambda x: x["i"]))

    def found(few: Column) -> Column:
        looked_up = F.filter(F.transform(keys, lambda k, i: F.when(F.array_contains(few, k), i)), F.isnotnull)
        return F.when(F.size(few) <= FEW, looked_up).otherwise(
            F.get(F.transform(F.array(pairs), places), F.lit(0))
        )

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return F.get(F.transform(F.transform(ordered, found), covered), F.lit(0))


def references(counted: DataFrame, lang: str = "lang") -> tuple[list[tuple[list[float], list[float]]], DataFrame | None]:
    """Class and word distributions of each language, over all documents labelled with it.

    Languages with MIN_REFERENCE_SHARE of the words reach the driver, at most 1 / MIN_REFERENCE_SHARE of
    them. The others stay a table (__lang, __q0, __q1); None if there are none.
    """
    n_classes, n_words = len(CLASSES) + 1, len(_distinct_words()) + 1
    sums = [F.sum(F.col("q_classes")[i]).alias(f"c{i}") for i in range(n_classes)]
    sums += [F.sum(F.col("q_words")[i]).alias(f"w{i}") for i in range(n_words)]
    by_lang = counted.where(F.col(lang).isNotNull()).groupBy(lang).agg(F.sum("n_words").alias("n"), *sums)
    by_lang = written(by_lang.where("n > 0"), "languages")
    total = by_lang.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= total * MIN_REFERENCE_SHARE
    kept = by_lang.where(often).collect()
    rare = by_lang.where(~often)

    def shared(prefix: str, n: int) -> Column:
        values = F.array(*[F.col(f"{prefix}{i}") for i in range(n)])
        whole = F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)
        return F.transform(values, lambda x: x / F.greatest(whole, F.lit(1)))

    def shares(row, prefix: str, n: int) -> list[float]:
        values = [row[f"{prefix}{i}"] for i in range(n)]
        return [v / max(sum(values), 1) for v in values]

    table = rare.select(F.col(lang).alias("__lang"), shared("c", n_classes).alias("__q0"), shared("w", n_words).alias("__q1"))
    often = [(shares(r, "c", n_classes), shares(r, "w", n_words)) for r in sorted(kept, key=lambda r: r[lang])]
    return often, None if rare.isEmpty() else table


def own_distance(histogram: str, total: Column, shares: str) -> Column:
    """distance() of an array of counts to an array of shares of the same row; null without shares."""
    n = F.greatest(total, F.lit(1)).cast("double")

    def part(count: Column, q: Column) -> Column:
        p, m = count / n, (count / n + q) / 2
        both = p * F.log2(p / m) + q * F.log2(q / m)
        return F.when(count <= 0, q).when(q <= 0, p).otherwise(both)

    parts = F.zip_with(histogram, shares, part)
    found = F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))
    return F.when(F.col(shares).isNotNull(), found)


def distance(counts: Sequence[Column], total: Column, shares: Sequence[float]) -> Column:
    """Jensen-Shannon distance (square root, logarithms to base 2) of a histogram to a distribution.

    One plain expression for each bin, which compiles to Java code; an empty bin adds half its share.
    """
    n = F.greatest(total, F.lit(1)).cast("double")

    def part(count: Column, q: float) -> Column:
        p = count / n
        if not q:
            return p
        m = (p + q) / 2
        return F.when(count > 0, p * F.log2(p / m) + q * F.log2(F.lit(q) / m)).otherwise(F.lit(float(q)))

    parts = F.array(*[part(c, q) for c, q in zip(counts, shares, strict=True)])
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def assess(docs: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """docs with the counts, base_failed, class_distance, word_distance and kept.

    The counted rows are written once to the shared folder, since references need all of them before
    any is judged; without keep_text the texts are left out of what is written and returned.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT of the words in repeated
    windows. kept: not base_failed, and both distances (to the nearest of the frequent languages and the
    document's own) within bounds where the text is long enough for them. Without references (no labelled words) distances are null and
    only the base rules count. Repeated rows and null ids are judged like any row.
    """
    narrow = counts(docs, text)
    narrow = written(narrow if keep_text else narrow.drop(text), "quality")
    refs, rare = references(narrow, lang)

    def nearest(histogram: str, which: int, total: Column) -> Column:
        counts = [F.get(F.col(histogram), F.lit(i)) for i in range(len(refs[0][which]))] if refs else []
        each = [distance(counts, total, r[which]) for r in refs]
        if rare is not None:
            each.append(own_distance(histogram, total, f"__q{which}"))
        return F.array_min(F.array(*each)) if each else F.lit(None).cast("double")

    chars = F.aggregate("q_classes", F.lit(0).cast("long"), lambda a, b: a + b)
    out = narrow.withColumn("__n", chars)
    if rare is not None:
        out = out.join(rare, out[lang] == rare["__lang"], "left")
    out = out.withColumns(
        {
            "class_distance": nearest("q_classes", 0, F.col("__n")),
            "word_distance": nearest("q_words", 1, F.col("n_words")),
        }
    ).drop("__n", "__lang", "__q0", "__q1")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    odd = ((F.col("word_chars") >= MIN_CLASS_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | (
        (F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    )
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(odd, F.lit(False))).drop("q_classes", "q_words")
