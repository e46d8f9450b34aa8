"""The registered queries of sparkloom.llm against DuckDB or brute force, on the smallest tables."""

import base64
import hashlib
import itertools
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as P
from sparkloom.llm import common, decontam, entry, hashing, quality, secrets

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are missing")
TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query_equals_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.QUERIES[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    con.execute(f"CREATE TABLE o AS {entry.ORACLE_SQL[name]}")
    names = sorted(r[0] for r in con.execute("DESCRIBE o").fetchall())
    assert names == sorted(df.columns)
    a, b = f"SELECT {', '.join(names)} FROM '{tmp_path}/out/*.parquet'", f"SELECT {', '.join(names)} FROM o"
    assert [con.execute(f"({x}) EXCEPT ALL ({y}) LIMIT 3").fetchall() for x, y in ((a, b), (b, a))] == [[], []]


def documents(spark):
    return {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_tokens(row, text, enc):
    ids = enc.encode_ordinary(text or "")
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    return ids


def test_bpe_query(spark):
    texts, enc = documents(spark), encoder()
    got = entry.QUERIES["op6_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        check_tokens(r, texts[r.doc_id], enc)


def plain_spans(text):
    """The three fixed patterns by the contract, written without the library."""
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    cue = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    out = [(m.start(), 0, m.end()) for m in re.finditer("(" + cue + """)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def best_tags(emit, move):
    """The best path over all 3^n paths for few tokens, else by the plain recursion on (score, path)."""
    paths = {t: (emit[0][t] + move[0][t], [t]) for t in (0, 1)}
    for row in emit[1:]:
        paths = {t: max((s + move[p][t] + row[t], [*way, t]) for p, (s, way) in paths.items() if not (p == 0 and t == 2)) for t in (0, 1, 2) if any(not (p == 0 and t == 2) for p in paths)}
    return max(paths.values())[1]


def check_spans(text, row, crf):
    """Base spans of a row against patterns written anew, the model's against a plain Viterbi over the trained weights;
    how many the model has."""
    kinds, base, more = ("assign", "access", "hex"), plain_spans(text), []
    file = secrets.file_features(text, len(secrets.possible(text)))
    for run in secrets.runs_of(text):
        emit = [[sum(float(crf.emit[k, t]) for k in slots) for t in range(3)] for slots in secrets.run_slots(text, run, file)]
        for tag, (a, b) in zip(best_tags(emit, crf.move.tolist()), run):
            if tag == 1:
                more.append([a, b])
            elif tag == 2:
                more[-1][1] = b
    more = [(a, 3, b) for a, b in more if not any(a < e and s < b for s, _, e in base)]
    assert row == ",".join(f"{(*kinds, 'crf')[k]}:{s}:{e}" for s, k, e in sorted(base + more))
    return base, len(more)


def test_secrets_query(spark):
    texts, kinds, crf = documents(spark), ("assign", "access", "hex"), secrets.trained()
    for r in entry.QUERIES["op2_secrets"](spark, SF).collect():
        base, n = check_spans(texts[r.doc_id] or "", r.spans, crf)
        said = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.n_crf == n
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
    # lines that have secrets for the model too
    texts = {i: t for i, (t, _) in enumerate(secrets.training_lines(120, 99, 0.3))}
    found = secrets.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert sum(check_spans(texts[r.doc_id], ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.spans), crf)[1] for r in found) > 50


def test_quality_query(spark):
    got = {r.doc_id: r for r in entry.QUERIES["op10_quality"](spark, SF).collect()}
    labels = common.table(spark, SF, "labels").collect()
    own = [(got[r.doc_id], r.quality) for r in labels if got[r.doc_id].held_out]
    assert sum(g.predicted == q for g, q in own) / len(own) > 0.9
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got.values()) and len(got) == 200


def plain_features(text):
    """The features of quality.FEATURES for a text, computed one by one from its bytes."""
    data = (text or "").encode()
    n, words = len(data), data.split()
    if not n:
        return [0.0] * 22
    share = lambda cs: sum(c in cs for c in data) / n
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    lines = [x for x in data.split(b"\n") if x.strip()]
    k, m = max(1, len(words)), max(1, len(lines))
    upper, digits, spaces, non_ascii = sum(65 <= c <= 90 for c in data) / n, share(b"0123456789"), share(b" \t\n\r\x0b\x0c"), sum(c > 127 for c in data) / n
    stops, commas, marks, symbols, bars = share(b"."), share(b",;:"), share(b"!?"), share(b"#$%&*<>@^~\\"), share(b"|/_=+")
    lower = sum(97 <= c <= 122 for c in data) / n
    bits = -sum(data.count(c) / n * math.log2(data.count(c) / n) for c in set(data))
    return [
        math.log(1 + n), math.log(1 + len(words)), min(40, mean), min(40, math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths))), upper, digits, spaces, non_ascii, stops, commas, marks, symbols, bars,
        max(0, 1 - lower - upper - digits - spaces - non_ascii - stops - commas - marks - symbols - bars), len(re.findall(rb"[!#$%&*<>@^~|]+(?=\s|$)", data)) / k, len(set(words)) / k, math.log(1 + len(lines)), math.log(1 + len(words) / m),
        1 - len(set(lines)) / m, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m, bits, math.log(1 + max(lengths)),
    ]


def test_quality_scores_by_another_way(spark):
    """Scores again: plain features, the same pairs, and gradient steps instead of Newton's until the loss is flat."""
    texts, labels = documents(spark), {}
    for r in common.table(spark, SF, "labels").collect():
        if r.quality is not None and texts.get(r.doc_id) is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            labels[r.doc_id] = max(r.quality, labels.get(r.doc_id, r.quality))
    x = {i: plain_features(t) for i, t in texts.items()}
    rows = sorted((labels[i], *reversed(x[i])) for i in labels)
    good, a = np.array([r[0] > 0 for r in rows]), np.array([r[:0:-1] for r in rows])
    mean, spread = a.mean(0), a.std(0) + 1e-9
    z = np.clip((a - mean) / spread, -8, 8)
    rng = np.random.default_rng(7)
    diff = z[rng.choice(np.flatnonzero(good), 40_000)] - z[rng.choice(np.flatnonzero(~good), 40_000)]

    def loss(w):
        return np.logaddexp(0, -(diff @ w)).mean() + 0.5e-3 * w @ w

    def slope(w):
        return -(diff / (1 + np.exp(diff @ w))[:, None]).mean(0) + 1e-3 * w

    w, step = np.zeros(22), 1.0
    seen = np.zeros(22)
    for t in range(1, 1500):  # accelerated descent, restarted where the loss rises
        new = seen - step * slope(seen)
        while loss(new) > loss(seen) - 0.4 * step * (slope(seen) ** 2).sum() and step > 1e-3:
            step /= 2
            new = seen - step * slope(seen)
        seen, w = new + (t % 50) / (t % 50 + 3) * (new - w), new
        if np.abs(slope(w)).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = min(len(s) - 1, max(1, round(len(s) * (1 - good.mean()))))
    bar = (s[k - 1] + s[k]) / 2
    got = {r.doc_id: r for r in entry.QUERIES["op10_quality"](spark, SF).collect()}
    for i, f in x.items():
        want = 1 / (1 + math.exp(-float(np.clip(np.clip((np.array(f) - mean) / spread, -8, 8) @ w - bar, -30, 30))))
        assert abs(got[i].score - want) < 0.01


def test_repeats_query(spark):
    """Documents that share fifty words in a row are found, and what is found is in another place too."""
    texts = {i: t or "" for i, t in documents(spark).items()}
    got = {r.doc_id: r for r in entry.QUERIES["op8_chunks"](spark, SF).collect()}
    where: dict[str, set] = {}
    for i, t in texts.items():
        w = t.split(" ")
        for k in range(len(w) - 49):
            where.setdefault(" ".join(w[k : k + 50]), set()).add(i)
    sharing = set().union(*(v for v in where.values() if len(v) > 1))
    assert len(sharing - set(got)) <= 0.02 * len(sharing)
    for r in got.values():
        data = texts[r.doc_id].encode()
        for a, z in (map(int, x.split(":")) for x in r.passages.split(",")):
            part = data[a : a + 72]
            assert data.find(part, data.find(part) + 1) > 0 or any(part in t.encode() for i, t in texts.items() if i != r.doc_id)


def links(texts, width, share):
    sets = {}
    for i, t in texts.items():
        w = t.encode().translate(hashing.LOWER).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {i: find(i) for i in sets}


def test_pipeline_by_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram jaccard join", "benchmark decontamination", "secret scan", "byte-level bpe"]
    docs = common.table(spark, SF, "documents")
    model = quality.learn(docs, common.table(spark, SF, "labels"))
    texts = {i: t for i, t in documents(spark).items() if model.scores(quality.np.array([quality.features(t)]))[0] >= 0.5}
    component = links(texts, 5, 0.8)
    texts = {i: t for i, t in texts.items() if component[i] == i}
    windows = set()
    for r in common.table(spark, SF, "benchmark").collect():
        w = decontam.words_of(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}

    def leaks(t):
        w = decontam.words_of(t)
        return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    crf = secrets.trained()
    texts = {i: secrets._redacted(t, secrets.all_spans(t, crf)[1], "[SECRET]") for i, t in texts.items() if not leaks(t)}
    got, enc = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}, encoder()
    assert set(got) == set(texts)
    for i, r in got.items():
        assert check_tokens(r, texts[i], enc) == r.tokens


def test_stages_keep_columns(spark):
    docs = common.table(spark, SF, "documents")
    odd = docs.limit(30).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert secrets.redact(odd).where(F.col("text").isNull()).count() == 1
