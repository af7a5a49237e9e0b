"""Features of pairs. All string work is done once a record; pairs only join records and compare."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import similarity as S
from tessella.functions import text as T
from tessella.operators import competition as C
from tessella.operators.blocking import PAIR
from tessella.operators.contracts import ContractError

S1, CAND = PAIR

#: Fixed names: the second stage's columns by where they come from.
CONTEXT = ["p", "score", "rank", "rec_n", "rec_sum", "rec_rank", "rec_other", "p_minus_other", "s1_n", "s1_n05", "s1_sum", "s1_max", "s1_rank", "p_over_s1max"]
SIBLING_KEYS = ["n1", "nn", "na", "nums"]
KEPT = ["n_tset", "n_ratio", "a_tset", "num_cov_a", "num_cov_b", "dig_ratio", "n1_in_b", "b_alen", "c_is_best", "c_margin"]
SECOND_STAGE = CONTEXT + [f"{k}_{x}" for k in SIBLING_KEYS for x in ("sup", "cnt", "share", "eq_s1")] + KEPT


class RecordAdapter(Protocol):
    """Where the records of pairs come from: joined() puts structs a (of the S1) and b (of the candidate) beside them."""

    def joined(self, pairs: DataFrame) -> DataFrame: ...


class Records:
    """Records of a table with entity_id. A pair without a record is an error when its row is made, or left out if `strict`
    is not set."""

    def __init__(self, records: DataFrame, strict: bool = True):
        self.records, self.strict = records, strict

    def joined(self, pairs: DataFrame) -> DataFrame:
        rec = self.records.select("entity_id", F.struct(*[c for c in self.records.columns if c != "entity_id"]).alias("r"))
        out = pairs
        for side, key in (("a", S1), ("b", CAND)):
            out = out.join(rec.withColumnsRenamed({"entity_id": key, "r": side}), key, "left" if self.strict else "inner")
            if self.strict:
                lost = F.raise_error(F.concat(F.lit("no record of "), F.coalesce(key, F.lit("null"))))
                out = out.withColumn(side, F.coalesce(side, lost))
        return out


@dataclass(frozen=True)
class FeatureConfig:
    gram: int = 3
    low: int = 2
    high: int = 4
    max_features: int = 50_000


def represent(records: DataFrame, normal=T.plain_key, gram: int = 3) -> DataFrame:
    """entity_id and country with a record's normalised texts, token and n-gram sets, numbers, codes and script flags."""
    name, addr = normal(T.present(F.col("business_name"))), normal(T.present(F.col("business_address")))
    base = records.select("entity_id", T.present(F.col("country")).alias("country"), F.col("business_address").alias("raw"), name.alias("name"), addr.alias("addr"))
    return base.select(
        "entity_id", "country", "name", "addr", F.array_distinct(T.words(F.col("name"))).alias("name_tokens"), F.array_distinct(T.words(F.col("addr"))).alias("addr_tokens"),
        T.gram_set(F.col("name"), gram).alias("name_grams"), T.gram_set(F.col("addr"), gram).alias("addr_grams"),
        F.array_distinct(F.regexp_extract_all("addr", F.lit("([0-9]+)"))).alias("nums"), T.postal_codes(F.col("raw"), F.col("country")).alias("postal"), T.locality(F.col("raw")).alias("place"),
        *[v.alias(f"is_{k}") for k, v in T.scripts(F.col("name")).items()],
    )


def sides(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs with structs a (of the S1) and b (of the candidate); a pair without a record is an error."""
    return Records(records).joined(pairs)


def spread(pairs: DataFrame) -> DataFrame:
    """Pairs dealt over all cores: comparing long strings costs far more than their bytes, by which Spark would put pairs
    of some megabytes into one task."""
    spark = pairs.sparkSession
    return pairs.repartition(2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *PAIR)


def unmatched(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Ids of pairs that have no record."""
    ids = pairs.select(F.col(S1).alias("entity_id")).union(pairs.select(CAND)).distinct()
    return ids.join(records.select("entity_id"), "entity_id", "left_anti")


def flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def pairwise(pairs: DataFrame, represented: DataFrame, jaro_winkler=S.jaro_winkler) -> DataFrame:
    """The 41 features of a pair that need no fitted model; missing evidence is 0. Cosines are joined beside them."""
    j = sides(pairs.select(*PAIR), represented)
    f = lambda side, n: F.col(f"{side}.{n}")
    has = lambda n: (f("a", n) != "") & (f("b", n) != "")
    some = lambda n: (F.size(f("a", n)) > 0) & (F.size(f("b", n)) > 0)
    jac = lambda n: S.jaccard(f("a", n), f("b", n))
    same = lambda n: F.size(F.array_except(f("a", n), f("b", n))) + F.size(F.array_except(f("b", n), f("a", n))) == 0
    meet = S.common(f("a", "postal"), f("b", "postal")) > 0
    country, postal = has("country"), some("postal") & (f("a", "country") == f("b", "country"))
    eq = lambda n: f("a", n) == f("b", n)
    j = j.withColumn("jw", jaro_winkler(f("a", "name"), f("b", "name")))
    out = {
        "source1_name_missing": flag(f("a", "name") == ""), "candidate_name_missing": flag(f("b", "name") == ""), "source1_address_missing": flag(f("a", "addr") == ""), "candidate_address_missing": flag(f("b", "addr") == ""),
        "name_exact": flag(has("name") & eq("name")), "name_jaro_winkler": F.round("jw", 6), "name_levenshtein_distance": F.levenshtein(f("a", "name"), f("b", "name")),
        "name_levenshtein_similarity": F.round(S.levenshtein_similarity(f("a", "name"), f("b", "name")), 6), "name_token_jaccard": F.round(jac("name_tokens"), 6), "name_common_token_count": S.common(f("a", "name_tokens"), f("b", "name_tokens")),
        "name_char_ngram_similarity": F.round(jac("name_grams"), 6), "name_length_ratio": F.round(S.length_ratio(f("a", "name"), f("b", "name")), 6),
        "address_exact": flag(has("addr") & eq("addr")), "address_token_jaccard": F.round(jac("addr_tokens"), 6), "address_common_token_count": S.common(f("a", "addr_tokens"), f("b", "addr_tokens")),
        "address_char_ngram_similarity": F.round(jac("addr_grams"), 6), "address_length_ratio": F.round(S.length_ratio(f("a", "addr"), f("b", "addr")), 6),
        "numeric_overlap": F.round(jac("nums"), 6), "numeric_disagreement": flag(some("nums") & ~same("nums")), "numeric_both_available": flag(some("nums")),
        "postal_evidence_available": flag(postal), "postal_match": flag(postal & meet), "postal_disagreement": flag(postal & ~meet),
        "locality_evidence_available": flag(some("place")), "locality_token_jaccard": F.round(jac("place"), 6), "country_match": flag(country & eq("country")), "country_disagreement": flag(country & ~eq("country")),
        "candidate_is_s2": flag(F.col(CAND).startswith("S2-")), "candidate_is_s3": flag(F.col(CAND).startswith("S3-")), "both_name_address_available": flag(has("name") & has("addr")),
        "name_address_mean_lexical": F.round((F.col("jw") + jac("addr_grams")) / (1 + flag(has("addr"))), 6), "both_exact_name_address": flag(has("name") & has("addr") & eq("name") & eq("addr")),
    }
    for k in ("latin", "devanagari", "other"):
        out |= {f"source1_name_has_{k}": flag(f("a", f"is_{k}")), f"candidate_name_has_{k}": flag(f("b", f"is_{k}")), f"name_{k}_script_match": flag(f("a", f"is_{k}") & f("b", f"is_{k}"))}
    return j.select(*PAIR, *[v.alias(k) for k, v in out.items()])


def with_cosines(features: DataFrame, names: DataFrame, addresses: DataFrame) -> DataFrame:
    """features with name_tfidf_cosine and address_tfidf_cosine, from tables (pair, cosine)."""
    out = features
    for n, c in (("name", names), ("address", addresses)):
        out = out.join(c.select(*PAIR, F.col("cosine").alias(f"{n}_tfidf_cosine")), PAIR, "left").fillna(0.0, [f"{n}_tfidf_cosine"])
    return out


def keys(records: DataFrame, ascii=T.ascii_text) -> DataFrame:
    """A record's keys for the third feature set: name and address key, numbers, digits, first number, script, legal forms."""
    name, addr = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    base = records.select("entity_id", name.alias("n"), addr.alias("a"), ascii(name).alias("na_"), ascii(addr).alias("aa_"))
    return base.select(
        "entity_id", T.name_key(F.col("na_")).alias("nn"), T.address_key(F.col("aa_")).alias("na"), T.number_set(F.col("a")).alias("nums"), T.digits(F.col("a")).alias("dig"),
        T.first_number(F.col("a")).alias("n1"), T.non_ascii(F.col("n")).alias("nonlatin"), T.legal_forms(F.col("na_")).alias("lg"),
    )


def rich(pairs: DataFrame, keyed: DataFrame, rarity: DataFrame | None, competition: DataFrame) -> DataFrame:
    """The third feature set (49 numbers, 45 without rarity): pairs (score, rank), keys(), token_rarity(), record_stats()."""
    rec = keyed if rarity is None else keyed.join(rarity, "entity_id", "left")
    top = F.max("score").over(Window.partitionBy(S1))
    j = spread(sides(pairs.withColumn("_top", top), rec).join(competition, CAND, "left"))
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    nosp = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    nums = lambda s: T.words(s("nums"))
    forms = lambda s: T.words(s("lg"))
    j = j.withColumns({"_d": S.token_diff(a("nn"), b("nn")), "_inter": S.common(nums(a), nums(b)), "_la": F.size(nums(a)), "_lb": F.size(nums(b))})
    out = {
        "score": F.col("score"), "rank": F.col("rank"), "ratio_top": S.guarded(F.col("score"), F.col("_top")), "gap_top": F.col("_top") - F.col("score"), "src3": flag(F.col(CAND).startswith("S3")),
        "n_ratio": S.ratio(a("nn"), b("nn")), "n_tset": S.token_set_ratio(a("nn"), b("nn")), "n_tsort": S.token_sort_ratio(a("nn"), b("nn")), "n_part": S.partial_ratio(a("nn"), b("nn")), "n_jw": S.jaro_winkler(a("nn"), b("nn")),
        "n_nosp": S.ratio(nosp(a("nn")), nosp(b("nn"))), "n_nosp_part": S.partial_ratio(nosp(a("nn")), nosp(b("nn"))), "n_eq": flag(a("nn") == b("nn")), "a_nlen": F.length(a("nn")), "b_nlen": F.length(b("nn")),
        "a_tset": S.token_set_ratio(a("na"), b("na")), "a_tsort": S.token_sort_ratio(a("na"), b("na")), "a_part": S.partial_ratio(a("na"), b("na")), "a_ratio": S.ratio(a("na"), b("na")), "a_alen": F.length(a("na")), "b_alen": F.length(b("na")),
        "num_inter": F.col("_inter"), "num_la": F.col("_la"), "num_lb": F.col("_lb"), "num_cov_a": F.when(F.col("_la") > 0, F.col("_inter") / F.col("_la")).otherwise(-1), "num_cov_b": F.when(F.col("_lb") > 0, F.col("_inter") / F.col("_lb")).otherwise(-1),
        "dig_ratio": S.ratio(a("dig"), b("dig")), "n1_ratio": S.ratio(a("n1"), b("n1")), "n1_in_b": flag((a("n1") != "") & F.array_contains(nums(b), a("n1"))), "a_nonlatin": flag(a("nonlatin")), "b_nonlatin": flag(b("nonlatin")),
    }
    if rarity is not None:
        out |= {f"{s}_{c}": F.col(f"{s}.{c}") for c in ("tok_min_ldf", "tok_mean_ldf") for s in "ab"}
    out |= {
        "lg_a_n": F.size(forms(a)), "lg_b_n": F.size(forms(b)), "lg_eq": flag(a("lg") == b("lg")), "lg_b_extra": F.size(F.array_except(forms(b), forms(a))), "lg_a_miss": F.size(F.array_except(forms(a), forms(b))),
        "lg_conflict": flag((a("lg") != "") & (b("lg") != "") & (S.common(forms(a), forms(b)) == 0)), "nm_extra_b": F.col("_d.extra"), "nm_miss_a": F.col("_d.missing"), "nm_extra_len": F.col("_d.extra_length"),
        "c_n": F.col("n_s1"), "c_is_best": flag(F.col("best_s1") == F.col(S1)), "c_margin": F.col("best_score") - F.col("score"), "c_second_gap": F.col("best_score") - F.col("second_score"), "c_ratio": S.guarded(F.col("score"), F.col("best_score")),
    }
    return j.select(*PAIR, *[v.cast("float").alias(k) for k, v in out.items()])


def simple(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Five features: equal names, equal addresses, Jaro-Winkler of both, token-set ratio of names."""
    j = spread(sides(pairs.select(*PAIR), keyed.select("entity_id", "nn", "na")))
    n, m = (F.col("a.nn"), F.col("b.nn")), (F.col("a.na"), F.col("b.na"))
    return j.select(*PAIR, flag(n[0] == n[1]).alias("name_exact"), flag(m[0] == m[1]).alias("address_exact"), S.jaro_winkler(*n).alias("name_jw"), S.jaro_winkler(*m).alias("address_jw"), S.token_set_ratio(*n).alias("name_token_set"))


def second_stage(pairs: DataFrame, keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """pairs (score, rank, p and others) with the columns of SECOND_STAGE: how p compares within record and S1, what the
    S1's other candidates agree on by keys(), and KEPT of rich(). Kept columns of a pair that kept lacks are null."""
    near = C.siblings(pairs.select(*PAIR, "p"), keyed.select("entity_id", *SIBLING_KEYS), SIBLING_KEYS).drop("p")
    return C.record_context(pairs).join(near, PAIR).join(kept.select(*PAIR, *KEPT), PAIR, "left")


def require_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    """df if it has just these feature columns, in this order, behind the pair."""
    if (have := [c for c in df.columns if c not in PAIR]) != columns:
        raise ContractError(f"feature columns differ: {sorted(set(have) ^ set(columns)) or 'their order'}")
    return df
