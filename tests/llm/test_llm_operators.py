"""Operators of sparkloom.llm on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import itertools
import json
import os
import random
import textwrap

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers as P
from sparkloom.llm import bpe, chunks, common, decontam, graph, hashing, jaccard, licenses, lines, quality, secrets, tools, warc

RANKS, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def engine():
    return bpe.PrefixBPE(bpe.load_ranks(RANKS), PATTERN)


def words(r, n, vocabulary=60):
    return [r.choice(["the", "of", "é", "Straße", "x1"]) if r.random() < 0.3 else "w" + str(r.randrange(vocabulary)) for _ in range(n)]


# --- byte-level BPE -------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(engine, encoder):
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("abcdeinst éü中!?# \n\t'0123😀") for _ in range(r.randint(0, 60)))
        ids = engine.encode(text)
        assert ids == encoder.encode_ordinary(text) and engine.decode(ids) == text.encode()
    for token in engine.tokens[::97]:
        assert engine.piece(token) == [engine.ids[token]]


def test_bpe_states(engine):
    """Appends and edits give what encoding anew gives, and every prefix's encoding is there."""
    r = random.Random(2)
    state, data = bpe.PrefixState(), b""
    for _ in range(60):
        more = bytes(r.choice(b"abcinst o") for _ in range(r.randint(1, 6)))
        engine.extend(state, more)
        data += more
        assert engine.tokens_of(state) == engine.merged(data)
    for _ in range(40):
        a, z = sorted(r.choices(range(len(data) + 1), k=2))
        new = bytes(r.choice(b"abcinst o") for _ in range(r.randint(0, 5)))
        engine.edit(state, a, z, new)
        data = data[:a] + new + data[z:]
        assert bytes(state.data) == data and engine.tokens_of(state) == engine.merged(data)
    assert all(engine.merged(data[:k])[-1] == state.last[k] for k in range(1, len(data) + 1))


def test_bpe_blocks(engine, encoder):
    r = random.Random(3)
    text = " ".join(words(r, 3000)) + "\n\n  " + "x" * 5000 + "  end"
    parts = list(bpe.blocks(text, 500))
    assert "".join(parts) == text and len(parts) > 5
    assert [t for p in parts for t in engine.encode(p)] == encoder.encode_ordinary(text)


def test_bpe_rows(spark, encoder):
    texts = [None, "", "a b", "a b", " x" * 100_000, "\x00é "]
    df = spark.createDataFrame([(None if i == 3 else i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(df, RANKS, PATTERN, with_tokens=True).collect()
    assert len(got) == len(texts)
    for t, r in zip(texts, sorted(got, key=lambda r: 3 if r.doc_id is None else r.doc_id)):
        ids = encoder.encode_ordinary(t or "")
        assert (r.n_tokens, r.tokens, r.decoded_sha256) == (len(ids), ids, hashlib.sha256((t or "").encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), RANKS, PATTERN).count() == 0


# --- decontamination ------------------------------------------------------------------------------------------------


def brute_hits(text, items, width):
    own = decontam.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        w = decontam.words_of(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            x = w[i : i + width]
            for j in range(len(own) - len(x) + 1):
                if own[j : j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    found.add(item)
    return len(own), len(hit), found


@pytest.mark.parametrize(("block_bytes", "pass_blocks"), [(1 << 20, 64), (300, 64), (300, 2)])
def test_decontamination(spark, block_bytes, pass_blocks):
    r = random.Random(4)
    items = [(i, " ".join(words(r, r.choice([0, 1, 2, 9, 10, 14, 40]), 8))) for i in range(25)] + [(7, "w1 w2"), (None, "w3 w4 w5 w6 w7"), (99, None)]
    docs = [(i, " ".join(words(r, r.randint(0, 120), 8)) + r.choice(["", "!", " " + items[r.randrange(20)][1].upper() + ".", "…"])) for i in range(60)] + [(None, None), (5, ""), (5, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("runs", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_windows(d.select("doc_id", "text"), b, 10, block_bytes=block_bytes, pass_blocks=pass_blocks, keep=("doc_id", "text")).collect()
    assert len(found) == len(docs)
    for x in found:
        n, hit, who = brute_hits(x.text, items, 10)
        assert (x.n_words, sum(x.runs[1::2]) - sum(x.runs[::2])) == (n, hit)
        assert x["items"] == sorted(str(i) for i in who if i is not None)
    kept = decontam.decontaminate(d, b, 10).collect()
    assert len(kept) == sum(not x.runs for x in found) and kept[0]["items"] == "clash"
    assert decontam.find_windows(d, b.limit(0)).where(F.size("runs") > 0).isEmpty() and decontam.find_windows(d.limit(0), b).isEmpty()


# --- secrets --------------------------------------------------------------------------------------------------------


def test_secret_patterns():
    spans = lambda t: [(secrets.KINDS[k], t[s:e]) for s, k, e in secrets.base_spans(t)]
    assert spans('x Token = "abc123" y') == [("assign", 'Token = "abc123')]
    assert spans("token:token:abcdefgh") == [] and spans("paſſword=abcdefgh") == []
    assert spans("AKIA" + "A" * 15) == [] and spans("AKIA" + "A" * 16) == [("access", "AKIA" + "A" * 16)]
    h = "0123456789abcdef" * 2
    assert spans(f"secret={h}") == [("assign", f"secret={h}"), ("hex", h)] and spans("é" + h)[0] == ("hex", h) and spans("a" * 23) == []


def test_crf_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    model = secrets.Crf(r.normal(size=(secrets._SIZE, 3)), r.normal(size=(3, 3)))
    for n in range(1, 6):
        slots = [r.integers(0, secrets._SIZE, 4) for _ in range(n)]
        e = model.scores(slots)

        def score(path):
            s = e[0][path[0]] + model.move[0][path[0]]
            return s + sum(model.move[a][b] + e[i + 1][b] for i, (a, b) in enumerate(zip(path, path[1:])))

        allowed = [p for p in itertools.product(range(3), repeat=n) if p[0] != 2 and all((a, b) != (0, 2) for a, b in zip(p, p[1:]))]
        assert model.viterbi(slots) == list(max(allowed, key=score))


def test_crf_held_out_accuracy():
    model = secrets.trained()
    hit = wrong = missed = 0
    for text, spans in secrets.training_lines(300, seed=977):
        want = []
        for s, e in spans:
            if want and s - want[-1][1] == 1:
                want[-1] = (want[-1][0], e)
            else:
                want.append((s, e))
        got = set(secrets.crf_spans(text, model))
        hit, wrong, missed = hit + len(got & set(want)), wrong + len(got - set(want)), missed + len(set(want) - got)
    assert hit / (hit + wrong) > 0.85 and hit / (hit + missed) > 0.85


def test_crf_runs_fall_apart_at_plain_words():
    model, text = secrets.trained(), "deploy key ghp_A8sK2mQ9xV4bN7cR1tY6wE3z then words until bearer Zk81hsQ0plM22vVt again"
    whole = secrets.crf_spans(text, model)
    assert [text[a:b] for a, b in whole] == ["ghp_A8sK2mQ9xV4bN7cR1tY6wE3z", "Zk81hsQ0plM22vVt"]


def test_crf_short_and_plain_secrets():
    """Near a cue word any token can be a secret; prose behind a cue word is none."""
    model = secrets.trained()
    found = lambda t: [t[a:b] for a, b in secrets.crf_spans(t, model)]
    assert found("pwd: hunter2") == ["hunter2"] and found("passphrase: CorrectHorse") == ["CorrectHorse"] and found("pwd=letmein1 x") == ["letmein1"]
    assert found("Bearer abcdefghijklmnop") == ["abcdefghijklmnop"] and found("the secret is AB12 CD34 EF56 thanks") == ["AB12 CD34 EF56"]
    assert secrets._redacted("my pwd: hunter2.", secrets.all_spans("my pwd: hunter2.", model)[1], "#").startswith("my pwd: #")
    for prose in ("the password must be reset by the user, each token is valid for a day", "the tokens were split by the tokenizer into words", "bearer of bad news", "Enter your password here and click on the button"):
        assert found(prose) == []
    hit = wrong = missed = 0
    for text, spans in secrets.training_lines(300, 978, 1.0):
        want = {(s, e) for s, e in spans if text[s - 1 : s] != " " or (s - 1) not in {x for _, x in spans}}
        starts, got = {s for s, _ in want}, {s for s, _ in secrets.crf_spans(text, model)}
        hit, wrong, missed = hit + len(got & starts), wrong + len(got - starts), missed + len(starts - got)
    assert hit / (hit + wrong) > 0.85 and hit / (hit + missed) > 0.85


def test_spans_that_touch():
    """Model spans that touch base spans go: against the comparison of all with all."""
    r = random.Random(5)
    model = secrets.trained()
    line = lambda: r.choice(["password=", "token: ", "key ", ""]) + "".join(r.choices("0123456789abcdef", k=r.randint(6, 40))) + r.choice([" ", "\n", ", ", ""])
    for _ in range(60):
        text = "".join(line() for _ in range(r.randint(1, 30)))
        base, every = secrets.all_spans(text, model)
        assert base == sorted(base) and every == sorted(base + [(a, 3, b) for a, b in secrets.crf_spans(text, model) if not any(a < e and s < b for s, _, e in base)])


def test_secret_tokens():
    """Cut behind = after a cue word, whole elsewhere; in order, without overlaps, in linear time."""
    words_at = lambda t: [t[a:b] for a, b in secrets.tokens_of(t)]
    assert words_at("db_password=ab x=y1234567") == ["db_password=", "ab", "x=y1234567"] and words_at("no cue in x1 here") == []
    for text in ("pwd1" * 50_000, ("x" * 200 + "pwd") * 1_000, "pwd=" * 20_000, "token " * 20_000):
        spans = secrets.tokens_of(text)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])) and all(a < b for a, b in spans)


def test_secret_places_see_the_whole_text():
    """Settings behind long prose are scored as the same settings at the front."""
    prose, settings = "some words of prose. " * 300, "\n" + "x = {a};\n" * 30 + "port = 8080x4412\npassword = hunter2\n" + "y = {b};\n" * 30

    def slots(text):
        run = next(x for x in secrets.runs_of(text) if any(text[a:b] == "8080x4412" for a, b in x))
        return [s.tolist() for s in secrets.run_slots(text, run, secrets.file_features(text, len(secrets.possible(text))))]

    first, last, code = slots(settings + prose), slots(prose + settings), [secrets._slot(f"code:{k}") for k in range(5)]
    assert first == last == slots(prose + settings + prose) and all(code[4] in s and code[0] not in s for s in last)
    model = secrets.trained()
    found = lambda t: [t[a:b] for a, b in secrets.crf_spans(t, model)]
    assert found(settings + prose) == found(prose + settings) == ["hunter2"]


def test_secret_rows(spark):
    long = "word " * 50_000 + "password=hunter22x"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "token = 'abcdef1'"), (3, "token = 'abcdef1'"), (4, long), (None, "a" * 200_000)], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {(r.doc_id, len(r.spans)) for r in secrets.scan(df).collect()}
    assert {(1, 0), (2, 0), (3, 1), (4, 1)} <= got and secrets.scan(df).count() == 6
    red = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert red[1].text is None and red[3].text == "[SECRET]'" and red[4].text.endswith("word [SECRET]") and red[3].spans == "clash"
    assert secrets.scan(df.limit(0)).isEmpty()
    assert secrets._redacted("abcdefgh", [(1, 0, 4), (2, 2, 6)], "#") == "a#gh"


# --- line rules, licences, tool calls ---------------------------------------------------------------------------------


def test_repeated_words(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", lines.repeated_words(lines.words_of(F.col("t"))).alias("n"))
    got = {x.i: x.n for x in df.collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        assert got[i] == len(covered), t


def test_line_rules(spark):
    good = "This is a fine sentence about many different things that go on for a while.\n"
    body = "".join(" ".join(f"w{i}x{k}" for k in range(12)) + ".\n" for i in range(8))
    rows = [(1, None, "x"), (2, "", "x"), (3, body + "Home | About | News | Mail\nSign in\nplease accept cookies now, dear reader of pages.\n", "x"), (4, "A!! B!! C!! D!! E!!\n" * 3 + body, "x"), (5, good + good, "x"), (5, good + good, "x"), (None, "x " * 100_000, "x")]
    got = lines.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, rules string")).collect()
    by = {r.doc_id: r.rules for r in got}
    assert len(got) == 7 and by[1].base_failed and not by[1].kept and by[1].clean_text == "" and by[2].n_words == 0
    assert (by[3].n_failed_lines, by[3].kept) == (3, True) and by[3].clean_text == body.strip("\n")
    assert by[4].n_failed_lines == 3 and by[4].n_dup_lines == 2 and by[5].n_dup_lines == 1
    assert by[None].n_words == 100_000 and by[None].base_failed
    assert lines.clean_lines(spark.createDataFrame([], "text string")).isEmpty()


def test_licenses(spark):
    mit = licenses.TEMPLATES[10][1]
    rows = [(1, "Released under the MIT License."), (2, "X\n" + mit.upper()), (3, " ".join(mit.split()[:9])), (4, None), (5, ""), (6, "mit\nlicense apache license MIT License general public license"), (6, "mit\nlicense apache license MIT License general public license"), (None, "license " * 20_000)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))).collect()
    by = {r.doc_id: r.license for r in got}
    assert len(got) == 8
    assert by[1].labels == ["mit"] and by[1].score == 1.0 and by[1].places == [3]
    assert by[2].labels == ["mit"] and by[2].base_labels == [] and by[3].labels == [] and by[3].score == 0.0
    assert by[4].n_words == by[5].n_words == 0 and by[4].labels == []
    assert by[6].base_labels == ["apache", "gpl", "mit"] and by[6].places == [0, 2, 4, 6]
    assert by[None].n_words == 20_000
    assert licenses.needed(10, "0.8") == 8 and licenses.needed(7, "0.8") == 6 and licenses.needed(1, "0.1") == 1


def test_license_join_equals_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(30)]
    templates = tuple((f"l{i}", " ".join(r.sample(vocabulary, r.randint(1, 9)))) for i in range(8))
    texts = ["\n".join(" ".join(r.choices(vocabulary, k=r.randint(0, 14))) for _ in range(3)) for _ in range(120)]
    got = {x.doc_id: x.license for x in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates, threshold="0.7", wrapped=False).collect()}
    for i, t in enumerate(texts):
        pairs = [(label, len(set(line.split()) & set(x.split())) / len(set(x.split()))) for line in t.split("\n") for label, x in templates]
        hits = [(label, c) for label, c in pairs if c >= 0.7 - 1e-12]
        assert got[i].labels == sorted({x for x, _ in hits}) and got[i].score == pytest.approx(max([c for _, c in hits], default=0.0))


def test_wrapped_licenses(spark, tmp_path):
    """Notices hard-wrapped as in real headers, with comment marks, have the label and score of the unwrapped ones."""
    rows, want = [], {}
    for label, text in licenses.TEMPLATES:
        for width, mark in ((70, " * "), (40, "# "), (24, "// "), (10, "")):
            want[len(rows)] = label
            rows.append((len(rows), "/*\n" + "\n".join(mark + x for x in textwrap.wrap("Some words first. " + text + " and more of them", width, break_long_words=False, break_on_hyphens=False)) + "\n*/"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in licenses.op3_licenses(spark, str(tmp_path)).collect()}
    assert {label for _, label in want.items()} >= {"mit", "bsd", "isc", "mpl", "gpl"}
    for i, label in want.items():
        assert label in got[i].labels.split(",") and got[i].score == 1.0, rows[i]


def test_wrapped_license_join_equals_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(40)]
    templates = tuple((f"l{i}", " ".join(r.choices(vocabulary, k=r.randint(3, 12)))) for i in range(8))
    texts = ["\n".join(" ".join(r.choices(vocabulary, k=r.randint(0, 9))) for _ in range(r.randint(1, 6))) for _ in range(120)]
    texts += ["x\n" + "v1 " * 5_000] + ["\n".join(x for w in t.split() for x in (r.choice(vocabulary), w)[r.random() < 0.8 :]) for _, t in templates]
    sizes = licenses.window_sizes(templates, "0.7")
    assert sizes == [len(x.split()) * 10 // 7 for _, x in templates]
    got = {x.doc_id: x.license for x in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates, threshold="0.7", wrapped=True).collect()}
    crossing = 0
    for i, t in enumerate(texts):
        hits, w = [], t.split()
        for (label, x), n in zip(templates, sizes):
            own = set(x.split())
            of_lines = max(len(set(line.split()) & own) for line in t.split("\n"))
            of_windows = max((len(set(w[k : k + n]) & own) for k in range(len(w))), default=0)
            if max(of_lines, of_windows) / len(own) >= 0.7 - 1e-12:
                hits.append((label, max(of_lines, of_windows) / len(own)))
                crossing += of_windows > of_lines
        assert got[i].labels == sorted({x for x, _ in hits}) and got[i].score == pytest.approx(max([c for _, c in hits], default=0.0))
    assert crossing >= 5


def test_tool_levels(spark):
    e = [("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("b", "a"), (None, "a")] + [(f"k{i}", f"k{i - 1}") for i in range(1, 70)] + [("m", "k60"), ("m", "d")]
    got = {r.id: r.level for r in tools.levels(spark.createDataFrame(e, "id string, needs string")).collect()}
    want = {"b": 1, "c": 2, "d": 3, "x": None, "y": None, "z": None, "m": 61} | {f"k{i}": i for i in range(1, 70)}
    assert got == want
    assert tools.levels(spark.createDataFrame([], "id string, needs string")).isEmpty()


def test_tool_calls(spark):
    schemas = {"t": {"n": {"type": "integer", "required": True, "minimum": 0}, "s": {"type": "string", "enum": ["a"]}, "a": {"type": "array"}, "x": {"type": "number"}}}
    calls = [("1", "t", '{"n": 1, "s": "a", "a": [1], "x": 1.5}', "l"), ("2", "t", '{"n": -1, "s": "b", "u": 1}', "l"), ("3", "t", '{"n": "1", "a": {}}', "l"), ("4", "t", "{bad", "l"), ("5", "q", "{}", "l"), ("6", "t", "[1]", "l"), (None, "t", '{"n": null}', "l"), ("1", "t", '{"s":"a","n":2}', "l")]
    results = [("1", 5, "late"), ("1", 3, "first"), ("9", 1, "none asked"), (None, 1, "x")]
    c = spark.createDataFrame(calls, "call_id string, name string, arguments string, link string")
    got = tools.link_calls(c, spark.createDataFrame(results, "call_id string, result_turn long, content string"), spark.createDataFrame([("2", "1"), ("3", "2"), ("4", "none")], "id string, needs string"), schemas).collect()
    assert len(got) == len(calls)
    by = {(r.call_id, r.arguments): r.link for r in got}
    errors = [by[(x[0], x[2])].errors for x in calls]
    assert errors == [[], ["range:n", "range:s", "unknown:u"], ["type:a", "type:n"], ["json"], ["tool"], ["json"], ["missing:n"], []]
    first = by["1", calls[0][2]]
    assert (first.result_turn, first.n_results, first.level) == (3, 2, 0)
    assert first.message == '{"arguments":{"a":[1],"n":1,"s":"a","x":1.5},"id":"1","name":"t","result":"first"}'
    assert by["3", calls[2][2]].level == 2 and by["4", "{bad"].message is None and by["5", "{}"].n_results == 0
    assert tools.link_calls(c.limit(0), spark.createDataFrame([], "call_id string, result_turn long, content string"), spark.createDataFrame([], "id string, needs string"), schemas).isEmpty()


# --- Jaccard join, components, chunks -------------------------------------------------------------------------------


def test_conversations(spark):
    """One conversation in parts, in topological order; a cycle, a null conversation, calls that are no JSON."""
    calls = [("a", f"k{i:03}", "t", '{"n": %d}' % i) for i in range(30)] + [("b", "x", "t", '{"n":1}'), ("b", "y", "t", "no json"), (None, "z", "t", "{}"), ("c", "p", "t", "{}"), ("c", "q", "t", "{}")]
    needs = [(f"k{i:03}", f"k{i + 1:03}") for i in range(29)] + [("x", "y"), ("p", "q"), ("q", "p")]
    c = spark.createDataFrame(calls, "conv string, call_id string, name string, arguments string")
    linked = tools.link_calls(c, spark.createDataFrame([("k003", 5, "fine")], "call_id string, result_turn int, content string"), spark.createDataFrame(needs, "id string, needs string"), {"t": {"n": {"type": "integer"}}})
    got = {(r.conv, r.part): (r.n_calls, json.loads(r.messages)) for r in tools.conversations(linked, "conv", part_calls=8).collect()}
    assert sorted(k for k in got if k[0] == "a") == [("a", i) for i in range(4)]
    said = [m for i in range(4) for m in got["a", i][1]]
    assert [m["id"] for m in said] == [f"k{i:03}" for i in range(29, -1, -1)] and said[26]["result"] == "fine" and said[0]["arguments"] == {"n": 29}
    assert [m and m["id"] for m in got["b", 0][1]] == [None, "x"] and got[None, 0][0] == 1 and got["c", 0][0] == 2
    assert all(r.messages == json.dumps(json.loads(r.messages), sort_keys=True, separators=(",", ":")) for r in tools.conversations(linked, "conv").collect())


def test_hashes():
    r = random.Random(7)
    seen = {}
    for _ in range(50):
        text = "".join(r.choice("ab é\t\n\x0b ") for _ in range(r.randint(0, 80))).encode()
        own = hashing.word_hashes(text)
        assert len(own) == len(text.split())
        for w, h in zip(text.split(), own.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(set(hashing.word_hashes(b"ab cd\n" * 400_000).tolist())) == 2 and len(hashing.word_hashes(b"a" * 3_000_000)) == 1


def brute_components(rows, width, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(hashing.LOWER).split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            label[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def noisy(r, base, share):
    return [w if r.random() > share else "n" + str(r.randrange(10**6)) for w in base]


@pytest.mark.parametrize(("width", "num", "block_sets", "broadcast_rows"), [(3, 90, 256, 10**6), (5, 80, 7, 0)])
def test_jaccard(spark, width, num, block_sets, broadcast_rows):
    r = random.Random(8)
    passage = words(r, 60, 10**6)
    rows = []
    for g in range(12):
        base = words(r, r.choice([4, 12, 40, 150, 300]), 10**6)
        rows += [" ".join(noisy(r, base, r.choice([0, 0.003, 0.01, 0.03, 0.1]))) for _ in range(r.choice([1, 3, 14]))]
    rows += [" ".join(words(r, r.randint(20, 90), 10**6) + passage) for _ in range(15)]
    rows += ["", None, "one", "ONE", "one two", "  \n", "same text of five words", "Same  text of five words", "x " * 30_000]
    rows += [rows[0], rows[0]]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    rows = [(None if k == 5 else i, t) for k, (i, t) in enumerate(zip(ids, rows))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).repartition(5)
    got = jaccard.similarity_components(df, width, num, 100, block_sets=block_sets, broadcast_rows=broadcast_rows).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, width, num, 100)


def test_jaccard_keeps_one(spark):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    # repeated ids and rows, nulls, another name for the id, other columns with names of the operator's own
    rows = [(30, None, 1), (4, a + " x", 1), (3, a, 1), (5, a, 1), (5, a, 1), (7, a, 1), (7, b, 1), (None, a, 1), (11, b + " y", 1), (20, "", 2), (20, "", 2), (2, "z", 3), (2, "z", 4), (2, "z", 4)]
    odd = spark.createDataFrame(rows, "key long, text string, th int").withColumnRenamed("th", "node")
    kept = jaccard.keep_one(odd, id_column="key").collect()
    assert sorted((r.key, r.text) for r in kept if r.text is not None) == [(2, "z"), (3, a), (7, b), (20, ""), (20, "")] and len(kept) == 6
    assert jaccard.similarity_components(odd.limit(0), id_column="key").isEmpty()


def test_jaccard_large_families(spark):
    """Families of many blocks: near copies in chains, and texts that are alike without a link."""
    r = random.Random(21)
    base = words(r, 60, 10**6)
    rows = []
    for i in range(60):  # each links with its neighbours, few with the first
        rows.append((i, " ".join(base[i // 4 : 40 + i // 4])))
    for i in range(60, 90):  # half of the words are shared by all
        rows.append((i, " ".join(base[:24] + words(r, 16, 10**6))))
    rows += [(90, rows[0][1]), (91, rows[59][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similarity_components(df, 2, 80, 100, block_sets=4).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 2, 80, 100)


def test_jaccard_lost_link(spark):
    """Two documents at the threshold exactly: 45 of 50 words."""
    rows = []
    for k in range(40):
        x = [f"{k}-u{i}" for i in range(50)]
        rows += [(2 * k, " ".join(x)), (2 * k + 1, " ".join(x[5:]))]
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(80)}


def test_jaccard_uneven_sets():
    """Sets whose hashes crowd in few fragments, small ones by all ways to drop a hash, sets of adjacent classes."""
    r, pairs = np.random.default_rng(17), 0
    for num in (50, 80, 90):
        c = jaccard.classes(num, 100)
        for _ in range(7000):
            n = int(r.integers(1, 200))
            crowd = np.sort(r.integers(0, 2**32, int(r.integers(1, 12))))
            x = np.unique((crowd[r.integers(0, len(crowd), n)].astype(np.uint64) << np.uint64(32)) + (r.integers(0, 2**34, n)).astype(np.uint64))
            most = int(len(x) * (100 - num) / 100)
            start = int(r.integers(0, len(x) - most + 1))
            y = np.delete(x, np.s_[start : start + most]) if r.random() < 0.5 else np.sort(r.permutation(x)[: len(x) - most])
            if not len(y) or 100 * len(y) < num * len(x):
                continue
            top = max(c.of(len(x)), c.of(len(y)))
            (kx, nx), (ky, ny) = ({k: (keys, need) for k, keys, need in jaccard.fragment_keys(z, c)}[top] for z in (x, y))
            assert len(np.intersect1d(kx, ky)) >= max(nx, ny)
            pairs += 1
    assert pairs > 15_000


def test_jaccard_guests():
    """Linked sets share enough keys in a class where one of them is at home; only units at home aren't negative."""
    r, c = np.random.default_rng(11), jaccard.classes(80, 100)
    adjacent = 0
    for _ in range(2000):
        n = int(r.integers(5, 150))
        y = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        x = np.sort(r.permutation(y)[: -(-len(y) * 80 // 100) + int(r.integers(0, 2))])
        homes = [c.of(len(z)) for z in (x, y)]
        assert homes[1] - homes[0] in (0, 1)
        adjacent += homes[0] != homes[1]
        (kx, need_x), (ky, need_y) = ({k: (set(keys.tolist()), need) for k, keys, need in jaccard.fragment_keys(z, c)}[homes[1]] for z in (x, y))
        assert len(kx & ky) >= max(need_x, need_y)
        units = [jaccard.unit_id(jaccard.digest(z)[0], h, homes[1] - h).view(np.int64)[0] for z, h in zip((x, y), homes)]
        assert [u >= 0 for u in units] == [h == homes[1] for h in homes] and max(units) >= 0
    assert 200 < adjacent < 2000


def test_jaccard_fragments():
    """What the candidates rest on: linked sets share as many keys as either of them needs."""
    r = np.random.default_rng(3)
    for num in (80, 90):
        c = jaccard.classes(num, 100)
        for _ in range(300):
            n = int(r.integers(1, 400))
            x = np.unique(hashing.mix(r.integers(0, 2**63, n).astype(np.uint64)))
            drop, add = int(r.integers(0, n // 8 + 1)), int(r.integers(0, n // 8 + 1))
            y = np.unique(np.concatenate((x[drop:] if len(x) > drop else x, hashing.mix(r.integers(0, 2**63, add).astype(np.uint64)))))
            both = len(np.intersect1d(x, y))
            if 100 * both < num * (len(x) + len(y) - both):
                continue
            fx, fy = ({k: (set(keys.tolist()), need) for k, keys, need in jaccard.fragment_keys(s, c)} for s in (x, y))
            top = max(c.of(len(x)), c.of(len(y)))
            shared = len(fx[top][0] & fy[top][0])
            assert shared >= max(fx[top][1], fy[top][1])


def test_jaccard_fragments_at_the_threshold():
    """Small sets at exactly the threshold, where one has more empty fragments than the slack and the other fewer."""
    r, c, mixed = np.random.default_rng(7), jaccard.classes(80, 100), 0
    for _ in range(12_000):
        n = 5 * int(r.integers(5, 25))
        x = np.unique(hashing.mix(r.integers(0, 2**63, n).astype(np.uint64)))
        y = np.sort(r.permutation(x)[: len(x) * 4 // 5])
        if 5 * len(y) != 4 * len(x):
            continue
        top = max(c.of(len(x)), c.of(len(y)))
        (kx, need_x), (ky, need_y) = ({k: (keys, need) for k, keys, need in jaccard.fragment_keys(s, c)}[top] for s in (x, y))
        mixed += (len(kx) == c.parts[top]) != (len(ky) == c.parts[top])
        assert len(np.intersect1d(kx, ky)) >= max(need_x, need_y)
    assert mixed > 100
    # 55 hashes in 13 of 15 fragments; one of 11 fragments each goes, and one of those fragments is empty then
    parts, fill = c.parts[c.of(55)], [0, 0, 1] + [4] * 10 + [7, 7]
    assert len(fill) == parts and sum(fill) == 55
    x = np.array([((f * 2**32 // parts + 1000 + i) << 32) + 17 * i for f, m in enumerate(fill) for i in range(m)], np.uint64)
    y = np.delete(x, [sum(fill[:f]) for f in range(2, 13)])
    assert len(y) == 44 and len(np.intersect1d(x, y)) == 44
    (kx, need_x), (ky, need_y) = ({k: (keys, need) for k, keys, need in jaccard.fragment_keys(s, c)}[c.of(55)] for s in (x, y))
    assert len(np.intersect1d(kx, ky)) >= max(need_x, need_y)


def test_overlaps_and_forest():
    r = np.random.default_rng(4)
    sets = [np.unique(hashing.mix(r.integers(0, 500, 80).astype(np.uint64))) for _ in range(20)]
    got = jaccard.overlaps(sets, width=16)
    for i, j in itertools.combinations(range(20), 2):
        assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert sorted(jaccard.forest(linked)) == [(0, 3), (0, 5), (1, 2)]


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(200, 200), (None, 1), (300, 301), (301, 300)]
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_gear():
    r = np.random.default_rng(5)
    data = r.integers(0, 256, 500).astype(np.uint8)
    got, h = chunks.gear(data), 0
    for i, b in enumerate(data.tolist()):
        h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
        if i >= 40:
            assert int(got[i]) == h


def test_cuts_resist_shifts():
    r = random.Random(10)
    text = " ".join(words(r, 4000, 5000)).encode()
    a, b = (set(chunks.chunk_digests(t, chunks.cuts(t))[:, 0].tolist()) for t in (text, text[:9000] + b"inserted words " + text[9000:]))
    assert len(a - b) <= 6
    ends = chunks.cuts(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= 96 and sizes[:-1].min() >= 8
    odd = ("é" * 400).encode()
    assert "".join(odd[s:e].decode() for s, e in zip([0, *chunks.cuts(odd)], chunks.cuts(odd))) == "é" * 400
    whole = chunks.cuts(text, mask_bits=4)
    old, chunks._PIECE = chunks._PIECE, 1000
    try:
        assert chunks.cuts(text, mask_bits=4) == whole
    finally:
        chunks._PIECE = old


def test_cuts_of_periodic_and_long_texts():
    """Forced cuts follow the content, and pieces of a long text are worked on as one."""
    r = random.Random(8)
    said = "conosciende " * 40
    a, b = (set(map(tuple, chunks.units_of(" ".join(words(r, n, 10**5)) + " " + said + " ".join(words(r, 30, 10**5)))[0].tolist())) for n in (37, 64))
    assert a & b
    long = " ".join(words(r, 1_700_000, 10**5)).encode()
    assert len(long) > 9 << 20
    ends = chunks.cuts(long)
    assert max(np.diff([0, *ends])) <= 100 and ends[-1] == len(long)
    # a passage across any place of a long text has the chunks that it has by itself
    every = {tuple(x) for x in chunks.chunk_digests(long, ends).tolist()}
    for at in (4 << 20, 8 << 20):
        k = int(np.searchsorted(ends, at))
        part = long[ends[k - 20] : ends[k + 20]]
        own = {tuple(x) for x in chunks.chunk_digests(part, chunks.cuts(part)).tolist()}
        assert len(own & every) > 30
    digests = chunks.units_of(long.decode())[0]
    old, chunks._PIECE = chunks._PIECE, 5000
    try:
        assert chunks.cuts(long) == ends and (chunks.units_of(long.decode())[0] == digests).all()
    finally:
        chunks._PIECE = old


def plain_units(text):
    """Cuts and units by the definition, byte by byte."""
    data, last, out, h = text.encode(), 0, [], []
    x = 0
    for c in data:
        x = ((x << 1) + int(chunks._GEAR[c])) & 0xFFFFFFFF
        h.append(x)

    def whole(end):
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        return end

    end = 0
    while last < len(data):
        end = next((e for e in range(last + 1, min(len(data), last + 96) + 1) if h[e - 1] >> 28 == 0 and e - last >= 8), None)
        if end is None:
            if len(data) - last <= 96:
                end = len(data)
            else:
                best = min(range(last + 8, last + 97), key=lambda e: h[e - 1])
                end = best
        last = whole(end)
        out.append(last)
    starts = [0, *out[:-1]]
    k = min(3, len(out))
    return [(data[starts[i] : out[i + k - 1]], tuple(out[i : i + k]), starts[i], out[i + k - 1]) for i in range(len(out) - k + 1)] if out else []


def test_repeated_passages_by_brute_force(spark):
    """Every span, shared and repeated, against units that are compared as bytes."""
    r = random.Random(12)
    passages = [" ".join(words(r, n, 10**4)) for n in (20, 40, 90)] + ["höre " * 60]
    rows = []
    for i in range(40):
        text = " ".join(words(r, r.randrange(5, 60), 10**5))
        for _ in range(r.randrange(3)):
            text += " " + r.choice(passages) + " " + " ".join(words(r, r.randrange(0, 40), 10**5))
        rows.append((i, text))
    rows += [(40, rows[3][1]), (40, rows[3][1]), (None, rows[5][1]), (41, None), (42, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted({(i is None, i or 0, t) for i, t in rows if t}, key=lambda x: x)
    units = {d: plain_units(d[2]) for d in order}
    sizes = lambda u: (u[0], tuple(b - u[2] for b in u[1]))
    places = {}
    for d in order:
        for u in units[d]:
            places.setdefault(sizes(u), []).append((d, u[2]))

    def joined(spans):
        out = []
        for a, z in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], z)
            else:
                out.append([a, z])
        return [(a, z) for a, z in out if z - a >= 90]

    # ties between documents of one id are decided by a hash: none here but whole rows
    want = {}
    for d in order:
        shared = joined([(u[2], u[3]) for u in units[d] if len(places[sizes(u)]) > 1])
        later = joined([(u[2], u[3]) for u in units[d] if len(places[sizes(u)]) > 1 and places[sizes(u)][0] != (d, u[2])])
        if shared:
            want[None if d[0] else d[1]] = (shared, later)
    got = {x.id: ([(p.start, p.end) for p in x.shared], [(p.start, p.end) for p in x.repeats]) for x in chunks.repeated_passages(df).collect()}
    assert got == want and len(want) > 10
    odd = df.select("doc_id", "text", F.lit(1).alias("_key"), F.lit(2).alias("_cut"))
    texts = dict(rows)
    for x in chunks.without_repeats(odd).collect():
        assert (x._key, x._cut) == (1, 2)
        if x.text is not None:
            data = texts[x.doc_id].encode()
            for a, z in reversed(want.get(x.doc_id, ((), ()))[1]):
                data = data[:a] + data[z:]
            assert x.text == data.decode()


def test_repeated_passages(spark):
    r = random.Random(11)
    passage = " ".join(words(r, 60, 10**5))
    own = lambda n: " ".join(words(r, n, 10**6))
    docs = [(1, own(80) + " " + passage + " " + own(50)), (2, own(30) + " " + passage + " " + own(90)), (3, own(200)), (4, own(10)), (5, None), (6, ""), (7, passage), (7, passage), (None, own(20) + " " + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("passages", F.lit(1))
    got = {x.id: x for x in chunks.repeated_passages(df).collect()}
    assert set(got) == {1, 2, 7, None} and not got[1].repeats and got[2].repeats and got[None].repeats
    for i, text in docs:
        if i in (1, 2):
            covered = b"".join(text.encode()[p.start : p.end] for p in got[i].shared)
            assert len(covered) > 0.6 * len(passage.encode()) and covered.decode() in passage
    clean = {x.doc_id: x.text for x in chunks.without_repeats(df).collect()}
    assert clean[1] == docs[0][1] and clean[3] == docs[2][1] and clean[5] is None and len(clean[2]) < len(docs[1][1]) - 150
    assert chunks.repeated_passages(df.limit(0)).isEmpty()
    assert chunks.repeated_passages(spark.createDataFrame([(1, own(300)), (1, own(300))], "doc_id long, text string")).isEmpty()


# --- WARC, quality --------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big, other = "é\r\n\r\nWARC/1.1 " * 120, "y" * 1000
    rows = [(1, "http://a\r\n/x", big), (5, "http://b/", big), (5, "http://b/", big), (3, None, big), (None, "http://n/", big), (7, "u", None), (8, "u", ""), (9, "u", "short"), (10, "u", "short"), (11, "u", other), (12, "u", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    for gzip, broadcast_rows in ((False, 0), (True, 10**6)):
        path = f"file:{tmp_path}/{gzip}"
        warc.write_archives(df.repartition(1), path, gzip=gzip, archive_bytes=1, broadcast_rows=broadcast_rows)
        records = warc.read_archives(spark, path)
        assert records.count() == len(rows) == records.select("record_id").distinct().count()
        got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolve(records).collect())
        n = len(big.encode())
        assert got == [(0, n, "response", None), (1, n, "revisit", 5), (3, n, "revisit", 5), (5, n, "response", None), (5, n, "response", None), (7, 0, "response", None), (8, 0, "response", None), (9, 5, "response", None), (10, 5, "response", None), (11, 1000, "revisit", 12), (12, 1000, "response", None)]
        payloads = {r.page_id: r for r in records.collect()}
        assert bytes(payloads[5].payload) == big.encode() and payloads[1].payload is None and bytes(payloads[7].payload) == b""
        assert payloads[11].refers_to_id == payloads[12].record_id and payloads[1].refers_to_id is None
    assert warc.to_parts(df.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))
    with pytest.raises(ValueError):
        list(warc.members(warc._member(b"cut")[:-3]))


def test_warc_archives_are_bounded(spark, tmp_path, monkeypatch):
    """Parts end by bytes, begin with a warcinfo record, and hold a gzip member for each record; one page may be larger."""
    r = random.Random(4)
    rows = [(i, None, "".join(r.choices("abcdefghijklmnop", k=400_000))) for i in range(24)] + [(99, None, "".join(r.choices("qrstuvwxyz0123456789", k=9 << 20)))]
    path = f"{tmp_path}/a"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), f"file:{path}", archive_bytes=4 << 20)
    files = [open(f"{path}/{f}", "rb").read() for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) > 1 and sorted(map(len, files))[-2] < 6 << 20
    kinds = []
    for data in files:
        own = [[f["warc-type"] for f, _ in warc.parse(m)] for m in warc.members(data)]
        assert own[0] == ["warcinfo"] and max(map(len, own)) == 1
        kinds += sum(own, [])
    assert kinds.count("response") == 25
    # by another reader: the whole file is one stream of gzip members
    import gzip

    assert sum(gzip.decompress(d).count(b"WARC-Type: response") for d in files) == 25


def test_bradley_terry():
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 4))
    good = x[:, 0] - 0.5 * x[:, 1] + 0.1 * r.normal(size=400) > -0.4
    model = quality.fit(x, good)
    assert ((model.scores(x) >= 0.5) == good).mean() > 0.93
    assert abs((model.scores(x) >= 0.5).mean() - good.mean()) < 0.01
    assert (quality.fit(x, np.ones(400, bool)).scores(x) >= 0.5).all() and (quality.fit(x, np.zeros(400, bool)).scores(x) < 0.5).all()
    assert (quality.fit(np.empty((0, 4)), np.empty(0, bool)).scores(x) >= 0.5).all()


def test_quality_rows(spark):
    good = "A fine text of plain sentences, written with care. It says something and then it ends."
    bad = "BUY!! NOW!! ###$$$ | a | b | c |"
    docs = [(i, (good + f" {i}" if i % 3 else bad * (1 + i % 4)), "clash") for i in range(90)] + [(200, None, "c"), (201, "", "c"), (None, good, "c"), (5, good, "c")]
    labels = [(i, int(i % 3 > 0)) for i in range(90)] + [(3, 0), (None, 1), (7, None), (999, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    l = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.learn(d, l)
    got = quality.score(d.drop("score"), model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 90 and r.doc_id != 5)
    assert quality.keep_good(d, l).columns == d.columns
    again = quality.learn(d.repartition(7), l.repartition(3))
    assert np.allclose(again.weights, model.weights)
    held = spark.range(50).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    import zlib

    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in held)
    assert quality.score(d.limit(0).drop("score"), model).isEmpty()


def test_learned_labels_are_not_the_held_out_ones(spark):
    """Wrong labels on held-out rows change nothing."""
    docs = spark.createDataFrame([(i, f"Plain words number {i}." if i % 2 else "!! ## " * (i + 1)) for i in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    spoiled = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.learn(docs, labels).weights, quality.learn(docs, spoiled).weights)


def test_shared_folder(spark):
    df = spark.range(5)
    kept = common.written(df, "x")
    assert kept.count() == 5 and common.shared_dir(spark).removeprefix("file:") in kept.inputFiles()[0]
    common.held("a")["k"] = 1
    assert common.held("a") == {"k": 1} and common.held("b") == {} and common.held("a") == {}


def test_bitmap_of_many_keys_and_rows_behind_it(spark):
    from sparkloom.llm import jaccard
    from sparkloom.llm.hashing import Bitmap, mix

    keys = mix(np.arange(600_000, dtype=np.uint64)).view(np.int64)
    known = Bitmap.of(spark.createDataFrame([(int(x),) for x in keys[:300]], "k long"), "k", 12, 2)
    assert known.has(keys[:300]).all() and known.has(keys[300:]).mean() < 0.03  # one probe lets 7 % through
    assert [Bitmap.bits_for(n) for n in (0, 2_000_000, 2_097_153, 10**9)] == [24, 24, 25, 28]
    rows = [(i, " ".join(f"w{i // 2 * 50 + j}" for j in range(40)), {"a": i}) for i in range(0, 400)] + [(None, None, None), (7, "", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a map` map<string,int>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard.keep_one(docs)
        assert sorted((str(r[0]), r[2]) for r in out.collect()) == sorted([(str(i), {"a": i}) for i in range(0, 400, 2)] + [("None", None), ("7", {})], key=str)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan[: plan.index("LeftAnti")] and "MapInArrow" in plan[plan.index("LeftAnti") :]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
