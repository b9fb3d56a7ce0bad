"""Quality rules and secret scans against plain versions."""

import random

import brute
import pytest
from barometry.llm import quality, secrets
from pyspark.sql import functions as F

HEX = "0123456789abcdef" * 3
HARD = [
    None, "", " \n\t", "one", "w " * 19, "x" * 5000, "same line\nsame line\n\n \nsame line\n", "a b c d e f g h a b c d e f g h", "a b c d e f g h i a b c d e f g h", "z " * 500,
    " ".join("p%d" % (i % 40) for i in range(90)), "# $ % & | < > *" * 9, "é\x0bè\x0c à\r\nÉ", "A" * 30 + " " + "b" * 30,
    'TOKEN = "abcdef"', "secret=token=abcdef", "password: 'abc' passwd:abcdefg", "api_key=ab apikey==abcdef é token=zzzzzz", f"{HEX} {HEX[:23]} {HEX[:24]}é{HEX[:30]}", "AKIA" + "Z" * 16 + " AKIA" + "9" * 15, "xAKIAAKIA" + "A1" * 12,
    "é" * 7 + " secret  :  \"p@ss\" Secret:=x/+y_z.w", "ghp_a1b2c3d4e5f6g7h8i9j0K and " + "Q1" * 20, "token=" + "a1b2" * 400, "token=abcdef " * 300,
]


@pytest.fixture(scope="module")
def rows(spark, sf):
    rng = random.Random(2)
    texts = [*HARD, *(" ".join(rng.choice(["a", "b", "c,", "\n", "dd", "E"]) for _ in range(rng.randrange(400))) for _ in range(30))]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return list(enumerate(texts))


def make(spark, rows):
    return spark.createDataFrame([(d, t, f"o{d % 7}", 1) for d, t in rows], "doc_id long, text string, source string, n_words int").repartition(3)


def test_quality_counts(spark, rows):
    got = {r.doc_id: r for r in quality.judged(make(spark, rows)).collect()}
    for d, t in rows:
        assert tuple(got[d])[1:7] == brute.quality_counts(t), t
        assert not (got[d].base_failed and got[d].kept)


def test_quality_keeps_clean_and_drops_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    counts = {(r.quality_label, r.kept): r.n for r in quality.judged(docs).join(labels.select("doc_id", F.col("quality").alias("quality_label")), "doc_id").groupBy("quality_label", "kept").agg(F.count("*").alias("n")).collect()}
    assert counts.get((1, False), 0) <= 0.05 * (counts[1, True] + counts.get((1, False), 0))
    assert counts[0, False] >= 0.85 * (counts[0, False] + counts.get((0, True), 0))


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(4)
    patterns, truth = {}, {}
    for _ in range(20000):
        good = rng.random() < 0.8
        v = tuple(rng.choices((-1, 0, 1), (0.05, 0.05, 0.9) if good else (0.6, 0.1, 0.3))[0] for _ in range(5))
        patterns[v] = patterns.get(v, 0) + 1
        truth.setdefault(v, [0, 0])[good] += 1
    post = quality.fitted(patterns, wrong=0.1, passed=0.0)
    right = sum(truth[v][post[v] >= 0.5] for v in patterns)
    # Compared with the best that any decision by pattern can do.
    assert right >= 0.995 * sum(map(max, truth.values()))


def junk_patterns(kinds, abstain, n=100000):
    """Counts of votes: kinds[k] of the documents break rule k alone; 'length' and 'lines' abstain on abstain of those they pass."""
    out = {}
    for k, share in [*enumerate(kinds), (None, 1 - sum(kinds))]:
        for a in (0, 1):
            for b in (0, 1):
                v = tuple(-1 if i == k else {0: a, 4: b}.get(i, 1) for i in range(7))
                part = share * (1 if k == 0 else abstain if a == 0 else 1 - abstain) * (1 if k == 4 else abstain if b == 0 else 1 - abstain)
                # A pattern of a broken rule has no second version.
                if round(n * part) and not (k == 0 and a) and not (k == 4 and b):
                    out[v] = out.get(v, 0) + round(n * part)
    return out


@pytest.mark.parametrize("abstain", [0.02, 0.1, 0.5])
def test_quality_holds_at_any_share_of_junk(abstain):
    worlds = [[share / 7] * 7 for share in (0.01, 0.05, 0.14, 0.21, 0.35, 0.5)]
    worlds += [[share / 7 + (0.33 if i == hot else 0) for i in range(7)] for hot in range(7) for share in (0.0, 0.01, 0.05, 0.14)]
    for kinds in worlds:
        post = quality.fitted(junk_patterns(kinds, abstain))
        assert all((q >= 0.5) == (-1 not in v) for v, q in post.items()), kinds
        assert all(post[a] >= post[b] - 1e-12 for a in post for b in post if all(x >= y for x, y in zip(a, b, strict=True))), kinds


def test_secret_spans(spark, rows):
    got = {r.doc_id: r for r in secrets.summary(secrets.classified(make(spark, rows))).collect()}
    for d, t in rows:
        want, base = brute.secrets(t)
        assert tuple(got[d])[1:5] == want, t
        assert set(filter(None, base.split(","))) <= set(got[d].spans.split(","))


def test_ownership_tells_examples_from_live(spark):
    shared, own, opaque = "token=SHARED123", "token=OWNED4567", "zz Q1w2E3r4T5y6U7i8O9p0 zz"
    docs = spark.createDataFrame([(i, f"x {shared} y", f"o{i}") for i in range(5)] + [(10, f"é {own} {own}", "o1"), (11, opaque, "o1"), (12, None, None), (10, f"é {own} {own}", "o1")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.summary(secrets.classified(docs)).collect()}
    assert (got[0].n_live, got[0].n_example) == (0, 1) and (got[10].n_live, got[10].n_example) == (2, 0)
    assert got[11].spans == "opaque:3:23" and got[12].spans == ""
    text = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert text[0] == f"x {shared} y" and text[10] == "é [SECRET] [SECRET]" and text[11] == "zz [SECRET] zz" and text[12] is None
    assert secrets.redacted(docs).count() == 9


def test_ownership_equals_a_plain_count(spark):
    rng = random.Random(3)
    values = ["v%05d" % i * 2 for i in range(25)]
    rows = [(i if i % 17 else None, f"a token={rng.choice(values[: rng.choice([3, 25])])} b", rng.choice(["o1", "o2", "o3", None]), rng.choice(["r1", "r2", "r3", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = sorted((r.id or -1, r.live[0].value if r.live else None) for r in secrets.classified(docs, repo_col="repo", max_owners=2, max_repos=4).collect())
    owners, repos = {}, {}
    for _, t, o, r in rows:
        owners.setdefault(t[8:-2], set()).add(o)
        repos.setdefault(t[8:-2], set()).add((o, r))
    live = lambda v: v if len(owners[v]) <= 2 and len(repos[v]) <= 4 else None
    # The two conditions matter each.
    assert {(len(owners[v]) <= 2, len(repos[v]) <= 4) for v in owners} >= {(False, False), (True, True), (True, False)}
    assert got == sorted((i or -1, live(t[8:-2])) for i, t, _, _ in rows)
    masked = secrets.redacted(docs, repo_col="repo").collect()
    assert sum("[SECRET]" in r.text for r in masked) == sum(live(t[8:-2]) is not None for _, t, _, _ in rows)


def test_positions_of_many_matches(spark):
    text = " ".join(f"é{'x' * (i % 5)} {i:06d}" for i in range(1500))
    from barometry.llm import spans

    row = spark.createDataFrame([(text,)], "t string").select(spans.found(F.col("t"), "[0-9]{6}", "n", 0).alias("s")).first()
    assert [(s.start, s.end, s.value) for s in row.s] == [(m.start(), m.end(), m[0]) for m in __import__("re").finditer("[0-9]{6}", text)]


def test_empty(spark):
    none = make(spark, [(1, "")]).limit(0)
    assert quality.judged(none).count() == 0 == secrets.classified(none).count() == secrets.redacted(none).count() == quality.filtered(none).count()
