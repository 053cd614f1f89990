"""The 41 features of a candidate pair, in their contractual order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.channels import ADDRESS_DIGITS, CHANNELS, EXACT_ADDRESS, EXACT_NAME, has, n_channels
from kindred.functions.similarity import edit_similarity, jaccard, with_similarities
from kindred.functions.text import country_key, words

#: Names and order.
NAMES = """name_exact name_edit_sim name_partial_sim name_token_sort_sim name_token_set_sim name_token_jaccard name_len_diff name_token_cnt_diff name_len_ratio
addr_exact addr_edit_sim addr_partial_sim addr_token_sort_sim addr_token_set_sim addr_token_jaccard addr_len_diff addr_token_cnt_diff addr_len_ratio
digit_exact digit_overlap digit_seq_sim digit_count_diff country_match country_both_present name_x_addr name_plus_addr
contr_same_name_diff_addr contr_same_addr_diff_name contr_digit_conflict contr_country_conflict
miss_s1_addr miss_cand_addr miss_either_addr miss_s1_name miss_cand_name
prov_exact_name prov_exact_address prov_address_digits prov_rare_token prov_ngram prov_n_channels""".split()
FIELDS = {"n": "name_norm", "a": "address_norm", "d": "address_dig", "c": "country"}


def with_fields(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Join both sides' fields as n1, n2 (names), a1, a2 (addresses), d1, d2 (digits), c1, c2 (countries); blank where a record is missing."""
    for side, key in ((1, "s1_id"), (2, "candidate_id")):
        own = rows.select(F.col("entity_id").alias(key), *[(country_key(c) if f == "c" else F.col(c)).alias(f"{f}{side}") for f, c in FIELDS.items()])
        pairs = pairs.join(own, key, "left").fillna("", [f"{f}{side}" for f in FIELDS])
    return pairs


def digested(rows: DataFrame) -> DataFrame:
    """``rows`` with their fields' digests in place of the fields (blanks stay blank), where pairs only ask whether they are equal."""
    return rows.select("entity_id", "source", *[F.when(F.col(c) == "", "").otherwise(F.md5(c)).alias(c) for c in FIELDS.values()])


#: Of ``word_sets``: the key of each exact channel, and the words that needn't travel since their field is equal.
SET_KEYS = {EXACT_NAME: "n", EXACT_ADDRESS: "a", ADDRESS_DIGITS: "d"}
SET_UNNEEDED = {EXACT_NAME: "nw", EXACT_ADDRESS: "aw"}


def word_sets(rows: DataFrame) -> DataFrame:
    """``entity_id, source, row_id``, n and a (digests of names and addresses, blanks stay blank), nw and aw (64-bit hashes of their distinct words), d (digits), c (country)."""
    kept = {"d": F.col(FIELDS["d"]), "c": country_key(FIELDS["c"])}
    for f in "na":
        text = F.col(FIELDS[f])
        kept[f] = F.when(text == "", "").otherwise(F.md5(text))
        kept[f"{f}w"] = F.array_distinct(F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " ")), lambda t: F.xxhash64(t)))
    return rows.select("entity_id", "source", "row_id", *[c.alias(n) for n, c in kept.items()])


def set_features(wide: DataFrame) -> DataFrame:
    """``s1_id, candidate_id, source, bits`` and the features of the rule score that need no string similarity, of pairs with both sides' ``word_sets``."""
    same = {f: F.col(f"{f}1") == F.col(f"{f}2") for f in "na"}
    # columns of their own, so that each is worked out once
    wide = wide.withColumns({f"shared_{f}": F.when(same[f], F.lit(0)).otherwise(F.size(F.array_intersect(f"{f}w1", f"{f}w2"))) for f in "na"} | {"overlap": token_jaccard("d")})
    found: dict[str, Column] = {}
    for f, name in (("n", "name"), ("a", "addr")):
        found[f"{name}_exact"] = equal(f)
        found[f"{name}_token_jaccard"] = F.when(same[f], F.lit(1.0)).otherwise(F.col(f"shared_{f}") / (F.size(f"{f}w1") + F.size(f"{f}w2") - F.col(f"shared_{f}")))
    found |= {"digit_exact": equal("d"), "digit_overlap": F.col("overlap"), "contr_digit_conflict": both("d") & (F.col("overlap") < 0.3), "contr_country_conflict": both("c") & (F.col("c1") != F.col("c2"))}
    return wide.select("s1_id", "candidate_id", "source", "bits", *[c.cast("float").alias(n) for n, c in found.items()])


def flag(condition: Column) -> Column:
    return condition.cast("float")


def equal(f: str) -> Column:
    """Equal and not blank."""
    a, b = F.col(f"{f}1"), F.col(f"{f}2")
    return (a == b) & (a != "")


def token_jaccard(f: str) -> Column:
    return jaccard(words(f"{f}1"), words(f"{f}2"))


def size_features(f: str) -> tuple[Column, Column, Column]:
    """Absolute differences of lengths and token counts; ratio of lengths, 0 if either is blank."""
    a, b = F.length(f"{f}1"), F.length(f"{f}2")
    ratio = F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))
    return F.abs(a - b), F.abs(F.size(words(f"{f}1")) - F.size(words(f"{f}2"))), ratio


def both(f: str) -> Column:
    return (F.col(f"{f}1") != "") & (F.col(f"{f}2") != "")


def sql_features() -> dict[str, Column]:
    """The features that need no string similarity, over the columns of ``with_fields`` and ``bits``."""
    found: dict[str, Column] = {}
    for f, name in (("n", "name"), ("a", "addr")):
        found[f"{name}_exact"], found[f"{name}_token_jaccard"] = equal(f), token_jaccard(f)
        found[f"{name}_len_diff"], found[f"{name}_token_cnt_diff"], found[f"{name}_len_ratio"] = size_features(f)
    found |= {"digit_exact": equal("d"), "digit_overlap": token_jaccard("d"), "digit_count_diff": F.abs(F.size(words("d1")) - F.size(words("d2")))}
    found |= {"country_match": equal("c"), "country_both_present": both("c")}
    found |= {"contr_digit_conflict": both("d") & (token_jaccard("d") < 0.3), "contr_country_conflict": both("c") & (F.col("c1") != F.col("c2"))}
    found |= {"miss_s1_addr": F.col("a1") == "", "miss_cand_addr": F.col("a2") == "", "miss_either_addr": (F.col("a1") == "") | (F.col("a2") == ""), "miss_s1_name": F.col("n1") == "", "miss_cand_name": F.col("n2") == ""}
    found |= {f"prov_{name}": has("bits", b) for b, name in CHANNELS.items()} | {"prov_n_channels": n_channels("bits")}
    return {k: c.cast("float") for k, c in found.items()}


def pair_features(pairs: DataFrame, rows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``s1_id, candidate_id, source`` and the 41 features of ``pairs(s1_id, candidate_id, source, bits)``; ``also``: columns of ``pairs`` to return besides.

    Similarities are worked out once for each different pair of strings of a batch; rows come
    from the join by candidate, so the pairs of a candidate are together.
    """
    wide = with_fields(pairs, rows)
    wide = with_similarities(with_similarities(wide, "n1", "n2", "ns"), "a1", "a2", "as")
    wide = wide.withColumn("ds", edit_similarity("d1", "d2"))
    found = sql_features()
    for s, name in (("ns", "name"), ("as", "addr")):
        found |= {f"{name}_{k}_sim": F.col(f"{s}.{k}") for k in ("edit", "partial", "token_sort", "token_set")}
    found |= {"digit_seq_sim": F.col("ds"), "name_x_addr": F.col("ns.edit") * F.col("as.edit"), "name_plus_addr": (F.col("ns.edit") + F.col("as.edit")) / 2}
    found["contr_same_name_diff_addr"] = equal("n") & both("a") & (F.col("a1") != F.col("a2")) & (F.col("as.edit") < 0.5)
    found["contr_same_addr_diff_name"] = equal("a") & both("n") & (F.col("n1") != F.col("n2")) & (F.col("ns.edit") < 0.5)
    return wide.select("s1_id", "candidate_id", "source", *also, *[found[n].cast("float").alias(n) for n in NAMES])


def features_of_pairs(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Features of given pairs; zeros for pairs without."""
    one = features.dropDuplicates(["s1_id", "candidate_id"])
    return pairs.select("s1_id", "candidate_id").join(one.select("s1_id", "candidate_id", *NAMES), ["s1_id", "candidate_id"], "left").fillna(0.0, NAMES)
