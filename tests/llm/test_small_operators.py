"""Token counts, URL filter, mixing, neighbours."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from textlm.llm import ann, mixing, tokencounts, urls


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(urls, "TREES", 6)


def test_token_counts_against_brute_force(spark, make_docs):
    import tiktoken

    texts = ["", None, "a", "hello world", "hello world", "<|endoftext|> it's 42\n\n  x", "é漢😀 " * 2000]
    code = tiktoken.Encoding("own", pat_str=tokencounts.PATTERN, special_tokens={},
                             mergeable_ranks=tokencounts._vocabulary(tokencounts.VOCABULARY))
    sizes = [len(code.encode_ordinary(t)) if t else 0 for t in texts]
    got = {r.n_tokens: r for r in tokencounts.token_report(make_docs([(i, t) for i, t in enumerate(texts)])).collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(sizes) and max(sizes) > tokencounts.RANGE
    for k, r in got.items():
        assert r.truncated_tokens == sum(min(s, k) for s in sizes) and r.total_tokens == sum(sizes)
        assert r.docs_up_to == sum(s <= k for s in sizes) and r.tokens_over == sum(s for s in sizes if s > k)
        assert r.quantile == r.docs_up_to / len(sizes)
    assert tokencounts.token_report(make_docs([])).count() == 0


def test_url_rules_and_parts(spark):
    rows = [(1, "http://A.Example.NET/en/x?q=1", "example.net/en/", "allow", "a.example.net", "/en/x"),
            (2, "https://b.net/de", "net/", "block", "b.net", "/de"),
            (3, "http://net/en/", "net/", "block", "net", "/en/"),
            (4, "http://badexample.com/de/", None, None, "badexample.com", "/de/"),
            (5, "http://www.example.com/de/a#top", "example.com/de/", "block", "www.example.com", "/de/a"),
            (6, "http://x.org/fr/", "org/fr/", "allow", "x.org", "/fr/"),
            (7, "http://x.net", None, None, "x.net", ""), (8, None, None, None, "", ""), (9, "no scheme", None, None, "", ""),
            (10, "a://b://c.net/", None, None, "b:", "//c.net/"), (None, "http://x.net?y/z", None, None, "x.net", ""),
            (11, "http://x.org/fr/" + "é" * 50_000, "org/fr/", "allow", "x.org", "/fr/" + "é" * 50_000)]
    pages = spark.createDataFrame([(r[0], r[1]) for r in rows], "page_id bigint, url string") \
        .selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS features", "0 AS label")
    got = {r.page_id: r for r in urls.url_report(pages).collect()}
    for page, _, rule, verdict, host, path in rows:
        r = got[page]
        assert (r.rule, r.host, r.path) == (rule, host, path) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    one = spark.createDataFrame([(1, "http://q.com/")], "page_id bigint, url string")
    assert urls.url_report(one).first().verdict == "allow" and urls.url_report(one.limit(0)).count() == 0


def test_trees_learn_from_the_rules(spark):
    rnd = random.Random(2)
    rows = [(i, f"http://h{rnd.randint(0, 9)}.{s}/{p}/{rnd.randint(1, 999)}")
            for i, (s, p) in enumerate((rnd.choice([("net", "a"), ("org", "fr")])) for _ in range(300))]
    rows += [(1000 + i, f"http://h{i}.org/it/{i}") for i in range(20)]
    got = urls.url_report(spark.createDataFrame(rows, "page_id bigint, url string")).where("page_id >= 1000").collect()
    assert sum(r.verdict == "allow" for r in got) >= 18  # like the allowed ones but for the path


def test_suffixes_are_counted_over_all_labelled_urls(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [f"http://h{rnd.randint(0, 60)}.{s}/fr/{rnd.randint(1, 99)}" for s in ("net", "org", "example.com") for _ in range(300)]
    seen, joined = {}, urls._with_suffixes

    def spied(d, tables, prior):
        seen.update({by: {r[by]: r for r in t.collect()} for by, t in tables.items()})
        return joined(d, tables, prior)

    monkeypatch.setattr(urls, "_with_suffixes", spied)
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    for bound in (urls.BROADCAST_BYTES, 0):
        monkeypatch.setattr(urls, "BROADCAST_BYTES", bound)
        assert urls.filter_urls(pages, train_rows=60).count() == len(rows)
        known = [(u.split("/")[2], float(".net/" in u)) for u in set(rows) if "example" not in u]
        prior = sum(y for _, y in known) / len(known)
        for by, n in (("tld", 1), ("dom", 2)):
            groups = defaultdict(list)
            for host, y in known:
                groups[".".join(host.split(".")[-n:])].append(y)
            assert set(seen[by]) == set(groups)
            for k, ys in groups.items():
                assert abs(seen[by][k][f"f_{by}_rate"] - (sum(ys) + 10 * prior) / (len(ys) + 10)) < 1e-9
                assert abs(seen[by][k][f"f_{by}_n"] - len(ys) / len(known)) < 1e-9


def targets(sizes):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in full]
        left, w = total - sum(3 * sizes[n] for n in full), sum(weight[n] for n in free)
        over = [n for n in free if left * weight[n] / w > 3 * sizes[n]]
        if not over:
            return {n: 3 * sizes[n] if n in full else left * weight[n] / w for n in names}
        full |= set(over)


def test_mix_meets_targets_and_reruns_agree(spark, make_docs):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rnd.choice([0, 3, 200, 900]))), rnd.choice(["b", "b", "b", "a", "ü", None]))
            for i in range(300)]
    rows += [(5, rows[5][1], rows[5][2]), (None, "x y", "a"), (400, None, "z"), (401, "w " * 60_000, "c"), (402, "one", "d")]
    df = make_docs(rows)
    out = mixing.mix_report(df).collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = targets(sizes)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 3 * mixing.BLOCK), (s, taken[s], t)
    again = mixing.mix_report(df.repartition(7, "lang", "doc_id")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert mixing.mix_report(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix_report(make_docs([(1, ""), (2, None)])).collect()] == [0, 0]


def test_mixed_rows_hold_the_documents_words(spark, make_docs, tmp_path):
    rnd = random.Random(8)
    said = lambda n: "".join(rnd.choice(["é", "b", "x漢"]) + rnd.choice([" ", " ", "\t", " \n "]) for _ in range(n))
    rows = [(i, rnd.choice(["", " \n"]) + said(rnd.choice([0, 1, 5, 31, 32, 33, 64, 200])), rnd.choice(["a", "b", None]))
            for i in range(150)] + [(200, None, "a"), (201, " \t", "b"), (None, "p q", "c"), (3, "p q", "c"), (3, "p q", "c")]
    path = f"{tmp_path}/mix"
    report = mixing.mix(make_docs(rows), shard_slots=20, path=path).collect()
    mixed = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.shard, r.slot))
    shards, taken, blocks, read = defaultdict(list), Counter(), {}, defaultdict(Counter)
    for r in mixed:
        shards[r.shard].append(r.slot)
        n = len(r.text.encode().split())
        assert n == r.words == sum(p["words"] for p in r.parts) <= mixing.BLOCK
        assert blocks.setdefault((r.source, r.block), r.text) == r.text
        read[r.source][r.block] += 1
        for p in r.parts:
            taken[p["doc_id"]] += p["words"]
    assert len(shards) > 3 and all(v == list(range(len(v))) for v in shards.values())
    got = Counter()
    for r in report:
        got[r.doc_id] += r.taken
    assert +got == taken and sum(taken.values()) > 0
    for s in ("a", "b", "c", None):  # each block once an epoch, and with every block read the words of the source
        size = sum(len((t or "").encode().split()) for _, t, x in rows if x == s)
        times = read[s].values()
        assert max(times) <= 3 and (len(times) < -(-size // mixing.BLOCK) or max(times) - min(times) <= 1)
        if len(times) == -(-size // mixing.BLOCK):
            words = Counter(w for (x, _), t in blocks.items() if x == s for w in t.encode().split())
            assert words == Counter(w for _, t, x in rows if x == s for w in (t or "").encode().split())
            joined = "".join(blocks[k] for k in sorted(k for k in blocks if k[0] == s))
            assert all(t + "\n" in joined for _, t, x in rows if x == s and (t or "").encode().split())


def test_permutation_is_one():
    for n in (1, 2, 3, 10, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(30, 16))
    vec = {i: (base[i % 30] + 0.5 * rnd.normal(size=16)).tolist() for i in range(3000)}
    vec |= {i: [6.0] + [0.0] * 15 for i in range(3000, 3100)}  # equal vectors: ties by id
    rows = [(k, v, 0) for k, v in vec.items()] + [
        (20_000, None, 0), (20_020, [0.0] * 16, 0), (20_040, [float("nan")] + [1.0] * 15, 0),
        (20_060, [None] + [1.0] * 15, 0), (20_080, [float("inf")] * 16, 0), (None, [9.0] * 16, 0), (20_100, [], 0),
        (40, vec[40], 0), (30_000, [1.0, 2.0], 0), (30_001, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = defaultdict(list)
    for r in ann.nearest(df, 20, shard_rows=700, query_block=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, x = np.array(list(vec)), np.array(list(vec.values()))
    assert set(got) == {int(i) for i in ids if i % 20 == 0} | {30_000}
    assert [(a, b) for a, b, _ in got[30_000]] == [(1, 30_001)]
    hit = n = 0
    for q, found in got.items():
        if q == 30_000:
            continue
        s = x @ np.array(vec[q])
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))][:20]
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(abs(float(np.dot(vec[v], vec[q])) - sc) < 1e-9 for _, v, sc in found)
        hit += len({v for _, v, _ in found} & set(best.tolist()))
        n += 20
    assert hit / n >= 0.9
    assert [v for _, v, _ in got[3000]] == list(range(3001, 3021))
    assert ann.neighbour_report(df.limit(0)).count() == 0
