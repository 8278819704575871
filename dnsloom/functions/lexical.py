"""Signs of generated names, as Column expressions and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.config import EngineConfig
from dnsloom.functions.names import clean_tlds, sld, suspicious_tld


def _entropy(kinds: Column, count, size: Column) -> Column:
    """Shannon entropy in bits over ``size`` of symbols that occur ``count(kind)`` times each."""
    return F.when(size > 0, F.aggregate(F.transform(kinds, lambda k: count(k) / size), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def entropy_full(s: Column) -> Column:
    """Frequencies of characters over the number of bytes. A character is counted by what its removal takes away."""
    kinds = F.filter(F.array_distinct(F.split(s, "")), lambda x: x != "")
    return _entropy(kinds, lambda k: F.length(s) - F.length(F.replace(s, k, F.lit(""))), F.octet_length(s))


def entropy_fast(s: Column) -> Column:
    """Over bytes; where each is a character, as over characters."""
    pairs = F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("(..)"), F.lit(1))
    by_bytes = _entropy(F.array_distinct(pairs), lambda k: F.size(F.filter(pairs, lambda x: x == k)), F.octet_length(s))
    return F.when(F.octet_length(s) == F.length(s), entropy_full(s)).otherwise(by_bytes)


def entropy(s: Column, cfg: EngineConfig) -> Column:
    """Over bytes, or over characters where the configuration asks for it."""
    return entropy_fast(s) if cfg.entropy_fast else entropy_full(s)


def consonant_ratio(s: Column) -> Column:
    letters = F.length(F.regexp_replace(s, "[^a-z]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(s, "[^b-df-hj-np-tv-z]", "")) / letters).otherwise(0.0)


def max_consonant_run(s: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(s, F.lit("([b-df-hj-np-tv-z]+)"), F.lit(1)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def consonant_suspicious(s: Column, cfg: EngineConfig) -> Column:
    return (F.octet_length(s) >= 4) & ((consonant_ratio(s) > cfg.consonant_ratio) | (max_consonant_run(s) > cfg.consonant_run))


def generated(d: Column, cfg: EngineConfig) -> Column:
    """Of the second-level label: high_entropy and consonants, both null below the length from which it is judged, or if nothing is to be judged."""
    s = sld(d)
    judged = (F.octet_length(s) >= cfg.dga_min_bytes) & F.lit(cfg.dga_enabled)
    high = F.when(judged, entropy(s, cfg) > cfg.entropy_threshold + 1e-9)
    return F.struct(high.alias("high_entropy"), F.when(judged, consonant_suspicious(s, cfg)).alias("consonants"))


def dga_reason(d: Column, cfg: EngineConfig, ngram_pass: Column | None = None, signs: Column | None = None) -> Column:
    """HIGH_ENTROPY, LEXICAL_ANALYSIS or null, judged on the second-level label of 8 bytes or more: by entropy, by consonants, and
    by the language models where ``ngram_pass`` (whether one accepts the label) is given. ``signs``: ``generated`` as a column."""
    signs = generated(d, cfg) if signs is None else signs
    chain = F.when(signs["high_entropy"], "HIGH_ENTROPY").when(signs["consonants"], "LEXICAL_ANALYSIS")
    if ngram_pass is not None:
        chain = chain.when(signs["consonants"].isNotNull() & ~ngram_pass, "LEXICAL_ANALYSIS")
    return chain


def banned_keyword(d: Column, cfg: EngineConfig) -> Column:
    """The leftmost banned keyword, or null. Strict: between dots, hyphens or the ends. Overlapping keywords: the leftmost, then the first listed."""
    words = sorted({k.lower() for k in cfg.keywords})
    if not words or not cfg.lexical_enabled:
        return F.lit(None).cast("string")
    any_of = "|".join("\\Q" + w + "\\E" for w in words)
    pattern = rf"(^|[.-])({any_of})(?=$|[.-])" if cfg.strict_keywords else rf"()({any_of})"
    hit = F.regexp_extract(F.lower(d), pattern, 2)
    return F.when((hit != "") & suspicious_tld(d, cfg.suspicious_tlds), hit)


def lexical_dims(spark, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """Keywords and suspicious TLDs as tables; both empty if lexical analysis is off or there are no keywords."""
    on = cfg.lexical_enabled and cfg.keywords
    words = sorted({k.lower() for k in cfg.keywords}) if on else []
    tlds = clean_tlds(cfg.suspicious_tlds) if on else []
    table = lambda name, values: spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values]).cast("array<string>")).alias(name))
    return table("keyword", words), table("tld", tlds)


def ngram_train(corpus: DataFrame, n: int = 2, floor: float = -6.5, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, n, gram, logp: log2 of each letter n-gram's share among those with the same first n - 1 letters, ``floor`` at least.

    Pairs are taken inside runs of a-z; counting combines on the map side, so only distinct n-grams move.
    """
    text = F.lower(text_col)
    runs = corpus.select(F.col(lang_col).alias("lang"), F.explode(F.regexp_extract_all(text, F.lit("([a-z]+)"), F.lit(1))).alias("w")).filter(F.length("w") >= n)
    runs = runs.groupBy("lang", "w").count()
    grams = runs.select("lang", "count", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - (n - 1)), lambda i: F.substr("w", i, F.lit(n)))).alias("gram"))
    counted = grams.groupBy("lang", "gram").agg(F.sum("count").alias("c"))
    head = Window.partitionBy("lang", F.substring("gram", 1, n - 1))
    return counted.select("lang", F.lit(n).alias("n"), "gram", F.greatest(F.log2(F.col("c") / F.sum("c").over(head)), F.lit(floor)).alias("logp"))


def ngram_score(names: DataFrame, model: DataFrame, n: int = 2, *, col: str = "name", missing: float = -6.5) -> DataFrame:
    """name, lang, score: mean log2 probability of the letter n-grams of each distinct name; other characters break the chain. Names without n-grams: no row."""
    return _scored(_letter_runs(names, n, col), model, n, col, missing).select(col, F.inline("scores"))


def ngram_judged(names: DataFrame, model: DataFrame, threshold: float, n: int = 2, *, col: str = "name", missing: float = -6.5) -> DataFrame:
    """As ngram_score, with passes: whether any language reaches the threshold, judged where a name's scores are."""
    scored = _scored(_letter_runs(names, n, col), model, n, col, missing)
    return scored.select(col, (F.array_max(F.transform("scores", lambda s: s["score"])) >= threshold).alias("passes"), F.inline("scores"))


def ngram_score_external(names: DataFrame, model: DataFrame, n: int = 3, *, col: str = "name", missing: float = -10.0) -> DataFrame:
    """As ngram_score, but other characters are dropped first, so they do not break the chain, and unknown n-grams score ``missing``."""
    bare = names.select(col).distinct().select(col, F.regexp_replace(F.lower(col), "[^a-z]", "").alias("w")).filter(F.length("w") >= n)
    return _scored(bare, model, n, col, missing).select(col, F.inline("scores"))


def _letter_runs(names: DataFrame, n: int, col: str) -> DataFrame:
    return names.select(col).distinct().select(col, F.explode(F.regexp_extract_all(F.lower(col), F.lit("([a-z]+)"), F.lit(1))).alias("w")).filter(F.length("w") >= n)


def _scored(runs: DataFrame, model: DataFrame, n: int, col: str, missing: float) -> DataFrame:
    """A row per name: scores, an array of (lang, score). Names are dealt by name already, and the model has a row per n-gram with a column
    per language, so where it is broadcast no n-gram moves, and a name's scores are sums kept side by side."""
    grams = runs.select(col, F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - (n - 1)), lambda i: F.substr("w", i, F.lit(n)))).alias("gram"))
    langs = sorted(r[0] for r in model.select("lang").distinct().collect() if r[0] is not None)  # a handful of languages
    own = lambda k: F.max(F.when(F.col("lang") == langs[k], F.col("logp"))).alias(f"p{k}")
    wide = model.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), *[own(k) for k in range(len(langs))])
    mean = lambda k: F.avg(F.coalesce(f"p{k}", F.lit(missing))).alias(f"s{k}")
    means = grams.join(wide, "gram", "left").groupBy(col).agg(F.count(F.lit(1)).alias("grams"), *[mean(k) for k in range(len(langs))])
    each = [F.struct(F.lit(v).alias("lang"), F.col(f"s{k}").alias("score")) for k, v in enumerate(langs)]
    return means.select(col, F.array(*each).cast("array<struct<lang:string,score:double>>").alias("scores"))


def ngram_verdicts(domains: DataFrame, model: DataFrame, cfg: EngineConfig) -> DataFrame:
    """sld, ngram_pass: whether a language of the configuration accepts each distinct second-level label that is long enough. Labels
    without letter pairs are accepted by none; where no language of the configuration is in the model, all pass."""
    names = domains.select(sld(F.col("domain")).alias("name")).filter(F.octet_length("name") >= cfg.dga_min_bytes).distinct()
    known = model.filter(F.col("lang").isin(list(cfg.ngram_languages)))
    passes = ngram_pass(ngram_score(names, known), cfg.ngram_threshold)
    any_ = known.agg((F.count(F.lit(1)) == 0).alias("_none"))
    judged = names.join(passes, "name", "left").crossJoin(F.broadcast(any_))  # one row
    return judged.select(F.col("name").alias("sld"), (F.col("_none") | F.coalesce("passes", F.lit(False))).alias("ngram_pass"))


def ngram_pass(scores: DataFrame, threshold: float, *, col: str = "name", languages: Sequence[str] | None = None) -> DataFrame:
    """name, passes: whether any language reaches the threshold. Unknown languages are ignored; with none at all every name passes."""
    kept = scores if languages is None else scores.filter(F.col("lang").isin(list(languages)))
    return kept.groupBy(col).agg((F.max("score") >= threshold).alias("passes"))
