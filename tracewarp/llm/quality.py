"""Document quality by distribution divergence, in DataFrame functions only.

A document's character-class histogram and its histogram of common words are
compared with references of its language by Jensen-Shannon distance (base 2,
square root, so 0..1). References are pooled counts over every document of that
language that passes the base rules, so they follow the corpus; the lists of
common words are fixed. Texts below ``min_words`` are too short for a stable
histogram and are judged by the base rules alone, as are languages without a
list. Features are counted once for each document and written to the shared
folder; references and verdicts are read from there.

Edge cases: a null text counts as empty (no words, ``base_failed``); a null or
unknown language has no reference, the distances are null and the base rules
decide; an empty table gives no rows; repeated rows are judged alike; columns
other than ``doc_id``, ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored

#: Function words per language, most frequent first (general knowledge, not fitted).
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "are", "be"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "pour", "qui", "dans", "du", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su"],
}
N_COMMON = 16
#: Lower-case letters and spaces go first; the other classes are counted in the short rest.
PLAIN = "[\\p{Ll} ]+"
#: Character classes and what to drop from that rest to leave each; white space and all else are two more.
CLASSES = (
    ("upper", "[^\\p{Lu}]+"),
    ("digit", "[^0-9]+"),
    ("pause", "[^.,;:'\"()-]+"),
    ("emphasis", "[^!?]+"),
    ("symbol", "[^#*$%&|<>]+"),
)
N_CLASSES = len(CLASSES) + 2
MIN_WORDS = 50
#: A limit is its first number plus its second over the square root of the words: the noise of a short histogram.
CHAR_LIMIT = (0.18, 0.8)
WORD_LIMIT = (0.15, 1.2)


def _kept_length(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def _list_of(lang: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for name, words in COMMON_WORDS.items():
        out = F.when(lang == name, F.array(*[F.lit(w) for w in words])).otherwise(out)
    return out


def base_features(docs: DataFrame, into: str = "__q") -> DataFrame:
    """``docs`` with word and line counts and both histograms as columns."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.withColumn(f"{into}_t", t)
    t = F.col(f"{into}_t")
    raw = raw.withColumn(f"{into}_w", F.array_remove(F.split(t, SPACES), ""))
    w, h = F.col(f"{into}_w"), F.col(f"{into}_h")
    raw = raw.withColumn(f"{into}_h", F.transform(w, lambda x: F.xxhash64(x)))
    raw = raw.withColumn(
        f"{into}_g",
        F.when(
            F.size(w) > 3,
            F.transform(F.slice(h, F.lit(1), F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    g = F.col(f"{into}_g")
    # Only texts that repeat some window sort theirs; a window is (hash, place).
    raw = raw.withColumn(
        f"{into}_p",
        F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    p = F.col(f"{into}_p")
    same = lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])
    raw = raw.withColumn(
        f"{into}_r", F.sort_array(F.transform(F.filter(p, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
    )
    r = F.col(f"{into}_r")
    covered = F.aggregate(
        F.transform(r, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(r, k - 1)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    raw = raw.withColumn(f"{into}_l", lines)
    hits = F.filter(F.transform(w, lambda x: F.array_position(_list_of(F.col("lang")), x)), lambda k: k > 0)
    raw = raw.withColumn(f"{into}_c", F.coalesce(hits, F.array().cast("array<bigint>")))
    c = F.col(f"{into}_c")
    raw = raw.withColumn(f"{into}_s", F.regexp_replace(t, PLAIN, ""))
    named = [_kept_length(F.col(f"{into}_s"), drop).cast("bigint").alias(name) for name, drop in CLASSES]
    raw = raw.withColumn(f"{into}_v", F.length(F.array_join(w, "")).cast("bigint"))
    raw = raw.withColumn(f"{into}_k", F.array(*named, F.length(t) - F.col(f"{into}_v")))
    k = F.col(f"{into}_k")
    # One column for each value: a struct would be inlined and evaluated again at each use.
    values = {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.col(f"{into}_v"),
        "n_symbols": F.get(k, F.lit(4)),
        "n_dup_lines": (F.size(F.col(f"{into}_l")) - F.size(F.array_distinct(F.col(f"{into}_l")))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")),
        "chars": F.concat(k, F.array(F.length(t) - F.aggregate(k, F.lit(0).cast("bigint"), lambda a, x: a + x))),
        "commons": F.concat(
            F.transform(F.sequence(F.lit(1), F.lit(N_COMMON)), lambda j: (F.size(c) - F.size(F.array_remove(c, j.cast("bigint")))).cast("bigint")),
            F.array((F.size(w) - F.size(c)).cast("bigint")),
        ),
    }
    return raw.withColumns({f"{into}_{name}": v for name, v in values.items()}).drop(*[f"{into}_{x}" for x in "twhgprlcsvk"])


def base_failed(q: str = "__q") -> Column:
    return (F.col(f"{q}_n_words") < 50) | (F.lit(100) * F.col(f"{q}_n_repeat_words") > F.lit(50) * F.col(f"{q}_n_words"))


def language_references(features: DataFrame, q: str = "__q") -> DataFrame:
    """One row for each language with a list: pooled counts of all its documents that pass the base rules."""
    sound = features.filter(F.col("lang").isin(list(COMMON_WORDS)) & ~base_failed(q))
    n_chars, n_words = N_CLASSES, N_COMMON + 1
    sums = sound.groupBy(F.col("lang").alias("__ref_lang")).agg(
        *[F.sum(F.get(F.col(f"{q}_chars"), F.lit(i))).alias(f"c{i}") for i in range(n_chars)],
        *[F.sum(F.get(F.col(f"{q}_commons"), F.lit(i))).alias(f"w{i}") for i in range(n_words)],
    )
    return sums.select(
        "__ref_lang",
        F.array(*[f"c{i}" for i in range(n_chars)]).alias("__ref_chars"),
        F.array(*[f"w{i}" for i in range(n_words)]).alias("__ref_commons"),
    )


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def js_distance(df: DataFrame, p: str, q: str, into: str) -> DataFrame:
    """Jensen-Shannon distance of two columns of counts; null if either is null or all zero."""
    df = df.withColumns({f"{into}_ps": _total(F.col(p)), f"{into}_qs": _total(F.col(q))})
    ps, qs = F.col(f"{into}_ps"), F.col(f"{into}_qs")
    part = lambda a, b: F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(
        F.transform(F.col(p), lambda x: x / F.nullif(ps, F.lit(0.0))),
        F.transform(F.col(q), lambda x: x / F.nullif(qs, F.lit(0.0))),
        lambda a, b: part(a, b) + part(b, a),
    )
    return df.withColumn(into, F.when((ps > 0) & (qs > 0), F.sqrt(F.greatest(F.lit(0.0), F.lit(0.5) * _total(terms)))))


def judge(features: DataFrame, q: str = "__q", min_words: int = MIN_WORDS, char_limit: tuple = CHAR_LIMIT, word_limit: tuple = WORD_LIMIT) -> DataFrame:
    """Stored features with distances (6 decimals) and the verdict ``__kept``.

    The references are at most one row for each list of words, so broadcasting
    them is bounded by ``len(COMMON_WORDS)``.
    """
    refs = language_references(features, q)
    joined = features.join(F.broadcast(refs), F.col("lang") == F.col("__ref_lang"), "left")
    long_enough = F.col(f"{q}_n_words") >= min_words
    for name in ("char", "word"):
        counts = f"{q}_{name.replace('word', 'common')}s"
        joined = js_distance(joined, counts, f"__ref_{name.replace('word', 'common')}s", f"__js_{name}_all")
        joined = joined.withColumn(f"__js_{name}", F.when(long_enough, F.round(F.col(f"__js_{name}_all"), 6)))
    root = F.sqrt(F.greatest(F.col(f"{q}_n_words"), F.lit(1)).cast("double"))
    within = lambda name, a, b: F.coalesce(F.col(name), F.lit(0.0)) <= F.lit(a) + F.lit(b) / root
    fits = within("__js_char", *char_limit) & within("__js_word", *word_limit)
    return joined.withColumn("__base_failed", base_failed(q)).withColumn("__kept", ~F.col("__base_failed") & fits)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each document: base counts, distances and the verdict."""
    out = judge(stored(base_features(docs.select("doc_id", "text", "lang")).drop("text")))
    return out.select(
        "doc_id",
        *[F.col(f"__q_{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__js_char").alias("js_char"),
        F.col("__js_word").alias("js_word"),
        F.col("__base_failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass by their own verdict, with the columns of ``docs``; ids play no part."""
    return judge(stored(base_features(docs))).filter("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql_list(lang: str) -> str:
    return "[" + ",".join(f"'{w}'" for w in COMMON_WORDS[lang]) + "]"


def oracle_sql() -> str:
    """DuckDB SQL for :func:`quality_report`."""
    lists = " ".join(f"WHEN '{k}' THEN {_sql_list(k)}" for k in COMMON_WORDS)
    bare = "coalesce(text, '')"
    keep = ["[^\\p{Lu}]+", "[^0-9]+", "[^.,;:''\"()-]+", "[^!?]+", "[^#*$%&|<>]+", "[^ \\x09-\\x0D]+"]
    chars = ", ".join(f"length(regexp_replace(t, '{x}', '', 'g'))" for x in keep)
    n_c, n_w = N_CLASSES, N_COMMON + 1
    csum = ", ".join(f"sum(cc[{i + 1}])::DOUBLE" for i in range(n_c))
    wsum = ", ".join(f"sum(ww[{i + 1}])::DOUBLE" for i in range(n_w))
    part = "(CASE WHEN {a} > 0 THEN {a} * log2(2.0 * {a} / ({a} + {b})) ELSE 0.0 END)"
    js = lambda p, q: (
        f"sqrt(greatest(0.0, 0.5 * list_sum([{part.format(a='z[1]', b='z[2]')} + {part.format(a='z[2]', b='z[1]')} "
        f"for z in list_zip([x / nullif(list_sum({p}), 0) for x in {p}], [x / nullif(list_sum({q}), 0) for x in {q}])])))"
    )
    return f"""
WITH a AS (SELECT row_number() OVER () AS rid, doc_id, lang, {bare} AS t,
             list_filter(regexp_split_to_array({bare}, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w,
             CASE lang {lists} END AS commons FROM documents),
b AS (SELECT *, len(w) AS n_words, [{chars}]::BIGINT[] AS k,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines,
        [w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)] AS g FROM a),
grams AS (SELECT rid, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM b),
twice AS (SELECT rid, gram FROM grams GROUP BY 1, 2 HAVING count(*) > 1),
places AS (SELECT DISTINCT rid, i + d AS place FROM grams JOIN twice USING (rid, gram), (VALUES (0), (1), (2)) v(d)),
repeats AS (SELECT rid, count(*) AS n FROM places GROUP BY 1),
f AS (SELECT rid, doc_id, lang, n_words, length(array_to_string(w, '')) AS word_chars, k[5] AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
        list_append(k, length(t) - coalesce(list_sum(k), 0)::BIGINT) AS cc,
        CASE WHEN commons IS NULL THEN NULL ELSE list_append(
          [len(list_filter(w, lambda x: x = c)) for c in commons],
          n_words - len(list_filter(w, lambda x: list_contains(commons, x)))) END AS ww
      FROM b LEFT JOIN repeats r USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
refs AS (SELECT lang, [{csum}] AS rc, [{wsum}] AS rw FROM v WHERE NOT base_failed AND ww IS NOT NULL GROUP BY 1),
d AS (SELECT v.*, CASE WHEN n_words >= {MIN_WORDS} AND rc IS NOT NULL THEN round({js('cc', 'rc')}, 6) END AS js_char,
        CASE WHEN n_words >= {MIN_WORDS} AND rw IS NOT NULL THEN round({js('ww', 'rw')}, 6) END AS js_word
      FROM v LEFT JOIN refs USING (lang))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, js_char, js_word, base_failed,
  NOT base_failed AND coalesce(js_char, 0) <= {CHAR_LIMIT[0]}::DOUBLE + {CHAR_LIMIT[1]}::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE)
    AND coalesce(js_word, 0) <= {WORD_LIMIT[0]}::DOUBLE + {WORD_LIMIT[1]}::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE) AS kept
FROM d"""
