"""Text functions and similarities against plain Python."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.functions import channels, similarity, text
from kindred.options import NormOptions

SHORT = st.text(alphabet="abc d", max_size=12)


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def test_normal_forms(spark):
    cases = {
        "D-4, Main St. & Co": "d 4 main st and co", "  ": "", "Straße ﬁn １２": "strasse fin 12", "हिमाचल प्रदेश।दिल्ली": "हिमाचल प्रदेश दिल्ली", "தமிழ்": "தமிழ்",
        "a​b‏c": "abc", "x\xa0y": "x y", "Ünï_1": "ünï_1", "한국 ハイフン-x": "한국 ハイフン x", "١٢، عربي": "١٢ عربي",
    }
    got = rows(spark, [*cases, None]).select("i", text.norm_text("v").alias("n"), text.norm_plain("v").alias("p")).orderBy("i").collect()
    assert [r["n"] for r in got] == [*cases.values(), ""]
    assert [text.norm_python(c) for c in cases] == list(cases.values()) and got[0]["p"] == got[0]["n"]
    literal = NormOptions(delete_hyphen=True, keep_all_marks=False)
    assert rows(spark, ["D-4"]).select(text.norm_text("v", literal)).first()[0] == "d4" == text.norm_python("D-4", literal)


def test_digits_tokens_keys(spark):
    df = rows(spark, ["12 b 034-12 १२", "", None])
    assert [r[0] for r in df.orderBy("i").select(text.address_digits("v")).collect()] == ["12 034 12 १२", "", ""]
    one = rows(spark, ["bb aaa ccc aaa dddd"]).select(text.token_set("v").alias("t"), text.window_keys(text.token_set("v"), 2).alias("w"), text.pair_keys(text.token_set("v")).alias("p"), text.id_prefix("v").alias("x")).first()
    assert one["t"] == ["aaa", "ccc", "dddd"] and one["w"] == ["aaa ccc", "ccc dddd"] and one["p"] == ["aaa ccc", "aaa dddd", "ccc dddd"] and one["x"] == "NO_PREFIX"
    forms = rows(spark, ["  É-x  ﬁ "]).select(*[text.profile_form("v", k) for k in range(5)], text.compact_form("v")).first()
    assert list(forms) == ["é-x  fi", "é-x  fi", "é x  fi", "é x fi", "e x fi", "éxﬁ"]


def test_channel_bits(spark):
    got = spark.createDataFrame([(0,), (5,), (31,)], "b int").select(channels.bits_to_channels("b"), channels.n_channels("b")).collect()
    assert [tuple(r) for r in got] == [("", 0), ("exact_name|address_digits", 2), ("exact_name|exact_address|address_digits|rare_token|ngram", 5)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def slow_ratio(a, b):
    return 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))


@settings(max_examples=300, deadline=None)
@given(SHORT, SHORT)
def test_similarities_are_brute_force(a, b):
    assert abs(similarity.ratio(a, b) - slow_ratio(a, b)) < 1e-12 and similarity.ratio(a, b) == similarity.ratio(b, a)
    if a and b:
        s, t = sorted((a, b), key=len)
        windows = [t[max(0, i) : i + len(s)] for i in range(1 - len(s), len(t))]
        best = max(slow_ratio(s, w) for w in windows if w)
        if len(a) == len(b):
            best = max(best, *(slow_ratio(t, s[max(0, i) : i + len(t)]) for i in range(1 - len(t), len(s))))
        assert abs(similarity.partial_ratio(a, b) - best) < 1e-12
    assert 0 <= similarity.token_set_ratio(a, b) <= 1 and similarity.token_sort_ratio(a, b) == similarity.token_sort_ratio(b, a)


def test_similarity_conventions():
    for f in similarity.SIMILARITIES.values():
        assert f("", "") == 1 and f("a", "") == 0 and f("ab c", "ab c") == 1
    assert similarity.token_set_ratio("a b c", "b a") == 1 and similarity.token_sort_ratio("b a", "a b") == 1


def test_many_pairs_are_one_by_one():
    rng = random.Random(13)
    words = ["alpha", "beta", "gam ma", "x", "été", "b", "aa", "abab", "", "12 34", "z" * 70]
    a = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(900)]
    b = [x if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for x in a]
    for name, many in similarity.MANY.items():
        want = [similarity.SIMILARITIES[name](x, y) for x, y in zip(a, b, strict=True)]
        got = many(a, b).tolist()
        assert all(abs(x - y) < 1e-12 for x, y in zip(got, want, strict=True)), name


def test_listed_marks_only():
    """Thai and Devanagari vowel signs are in the listed ranges, Bengali ones aren't."""
    some = NormOptions(keep_all_marks=False)
    assert text.norm_python("हिमाचल", some) == "हिमाचल" and text.norm_python("বাংলা", some) != "বাংলা" == text.norm_python("বাংলা")
