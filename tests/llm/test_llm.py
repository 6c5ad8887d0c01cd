import hashlib
import itertools
import math
import pathlib
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import decontaminate, embeddings, licences, near_text, packing, pii, quality, repeats, tokens, urls
from strandline.llm.queries import oracle_sql, queries
from tests.checking import assert_same
from tests.llm import near_recall

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, rep string, _gone int"


def docs_of(spark, texts, ids=None):
    """documents with columns that clash with the operators' own names."""
    rows = [(i if ids is None else ids[i], t, "en", "s", 0, 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rnd, n, stop="."):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) + (stop if rnd.random() < 0.1 else "") for _ in range(n))


ODD = [None, "", " \n\t ", "one", "one", "é漢\U0001f600 x\x00y", "a" * 5000, "\n\n", "<|endoftext|> <s> </s>", "  two   spaces ▁ here  "]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, data_dir, name):
    assert_same(queries()[name], oracle_sql()[name], spark, data_dir)


# 1 embeddings


def brute_links(vectors, t=0.95):
    good = {i: np.array(v, float) for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i in range(len(vectors))}
    for i, j in itertools.combinations(good, 2):
        a, b = good[i], good[j]
        if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= t:
            links[i].add(j)
            links[j].add(i)
    return links


@pytest.mark.parametrize("block", [7, 2048])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(block)
    base = rng.normal(size=(12, 6))
    vectors = [(base[rng.integers(12)] + 0.12 * rng.normal(size=6)).tolist() for _ in range(120)]
    vectors += [vectors[0], vectors[0], (2 * np.array(vectors[1])).tolist(), None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1.0, 2.0], [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, rep string")
    links = brute_links(vectors)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i].component_id == min(seen) and got[i].kept == (min(seen) == i)


def test_embeddings_without_ids(spark, tmp_path):
    v, w = [1.0, 2.0, 3.0], [-1.0, 0.5, 2.0]
    rows = [(None, v), (None, v), (3, w), (None, w), (4, w), (5, [w[0], w[1], 2.01])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 1, 0, True), (0, 1, 0, True), (0, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False), (5, 3, 3, False)]
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.1]), (3, [1.0, 0.05]), (None, [-1.0, 0.1]), (None, [-1.0, 0.0]), (None, [-1.0, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in embeddings.near_duplicates(df).orderBy("vec_id", "n_links", "component_id").collect()]
    assert sorted(got, key=repr) == sorted([(1, 2, 1, True), (3, 2, 1, False), (None, 2, 1, True)] + [(None, 2, None, True)] * 3, key=repr)
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(embeddings.SQL1).fetchall()
    assert sorted(want, key=repr) == sorted(got, key=repr)


def test_slack_covers_single_precision():
    rng = np.random.default_rng(5)
    for n in (3, 64, 4096):
        x = rng.normal(size=(400, n))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        y = x + 0.1 * rng.normal(size=x.shape) / np.sqrt(n)
        y /= np.sqrt((y * y).sum(1, keepdims=True))
        assert np.abs((x.astype(np.float32) @ y.astype(np.float32).T) - x @ y.T).max() <= embeddings.slack(n)


def test_embeddings_of_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# 2 repeats


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(2)
    shared = [prose(rnd, 70), prose(rnd, 49), prose(rnd, 50), " ".join(["same"] * 120)]
    texts = [" ".join(prose(rnd, rnd.randint(0, 40)) + " " + s for s in rnd.sample(shared, 2)) for _ in range(40)] + ODD + [shared[0], shared[0], "\t".join(shared[2].split())]
    ids = list(range(len(texts)))
    ids[-1] = ids[-2]  # a repeated id
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in repeats.remove_repeats(docs_of(spark, texts, ids)).collect())
    assert got == sorted(repeats.brute_force(list(zip(ids, texts))))
    assert sum(r[2] for r in got) > 1000
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0


def test_small_blocks_change_nothing(spark):
    rnd = random.Random(3)
    shared = prose(rnd, 80)
    texts = [prose(rnd, 20) + " " + shared for _ in range(30)]
    one = sorted(map(str, repeats.find_repeats(docs_of(spark, texts)).select("doc_id", F.array_sort("starts")).collect()))
    assert one == sorted(map(str, repeats.find_repeats(docs_of(spark, texts), block=500).select("doc_id", F.array_sort("starts")).collect()))


def test_places_come_from_the_automaton(spark, monkeypatch):
    rnd = random.Random(14)
    shared = prose(rnd, 80, "")
    docs = docs_of(spark, [prose(rnd, 30) + " " + shared, shared + " " + prose(rnd, 30), prose(rnd, 200)])
    removed = lambda: {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    assert removed() == {0: 0, 1: 80, 2: 0}
    phrases = repeats.confirmed

    def without(*args):
        found, copies = phrases(*args)
        return found.where("false"), copies

    monkeypatch.setattr(repeats, "confirmed", without)
    assert removed() == {0: 0, 1: 0, 2: 0}, "without a phrase in the automata nothing is found"


def test_whole_copies_go_and_change_nothing_else(spark):
    rnd = random.Random(15)
    a, b = prose(rnd, 60), prose(rnd, 55)
    texts, ids = [a, a.replace(" ", "  "), a + " " + b, b, b, a, prose(rnd, 20), None], [3, 4, 5, 6, 6, None, 8, 9]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in repeats.remove_repeats(docs_of(spark, texts, ids)).collect()}
    assert got == {(3, 60, 0), (4, 60, 60), (5, 115, 60), (6, 55, 55), (None, 60, 0), (8, 20, 0), (9, 0, 0)}


# 3 quality


def test_quality_of_held_out_documents(spark, data_dir):
    at = data_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in queries()["op3_quality"](spark, at).collect() if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(r.predicted for r in rows if labels[r.doc_id]), "good documents stay"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = quality.Field(rng.normal(size=3 * quality.N_BASE + 3), rng.normal(size=(2, 2)), 1.0, 0.0, 0.5)
    x = rng.normal(size=(5, quality.N_BASE)).astype(np.float32)
    z = quality.with_neighbours(x) @ field.emission
    weight, good = 0.0, np.zeros(5)
    for y in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(z[i] for i in range(5) if y[i]) + sum(field.transition[a, b] for a, b in zip(y, y[1:])))
        weight += w
        good += w * np.array(y)
    assert field.marginals(x) == pytest.approx((good / weight).tolist(), rel=1e-6)


def plain_score(field, text):
    """Score of a text by a log-space forward-backward pass over all its lines, written out plainly."""
    lines = [x.strip() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    if not lines:
        return field.share
    x = quality.line_features(lines)
    none = np.zeros(quality.N_BASE)
    score = []
    for i in range(len(lines)):
        v = [*x[i], *(x[i - 1] if i else none), *(x[i + 1] if i + 1 < len(lines) else none), float(i == 0), float(i == len(lines) - 1), 1.0]
        score.append((0.0, min(30.0, max(-30.0, float(np.dot(v, field.emission))))))
    t, n = field.transition, len(lines)
    ahead, back = [score[0]], [(0.0, 0.0)]
    for i in range(1, n):
        ahead.append(tuple(score[i][b] + np.logaddexp(ahead[-1][0] + t[0, b], ahead[-1][1] + t[1, b]) for b in (0, 1)))
        j = n - i
        back.append(tuple(np.logaddexp(t[a, 0] + score[j][0] + back[-1][0], t[a, 1] + score[j][1] + back[-1][1]) for a in (0, 1)))
    back.reverse()
    p = [1 / (1 + math.exp(min(700, f[0] + b[0] - f[1] - b[1]))) for f, b in zip(ahead, back)]
    q = min(max(sum(len(w) * v for w, v in zip(lines, p)) / sum(map(len, lines)), 0.002), 0.998)
    return 1 / (1 + math.exp(-min(30, max(-30, field.scale * math.log(q / (1 - q)) + field.shift))))


def test_quality_query_equals_a_plain_version(spark, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts, field = {r.doc_id: r.text for r in docs.collect()}, quality.train(docs, labels)
    rows = queries()["op3_quality"](spark, data_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        want = plain_score(field, texts[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    long = "\n".join(["Fine words stand here, one by one."] * 3000 + ["|||| 12 ###"] * 2000)
    assert field.score(long) == pytest.approx(plain_score(field, long), abs=1e-4)


def test_gradient_of_the_chain_is_the_numerical_one():
    rng = np.random.default_rng(1)
    seqs = [(rng.normal(size=(n, 3)), rng.integers(0, 2, n)) for n in (1, 3, 5)]

    def likelihood(emission, transition):
        total = 0.0
        for x, y in seqs:
            z = x @ emission
            ways = [sum(z[i] for i in range(len(y)) if c[i]) + sum(transition[a, b] for a, b in zip(c, c[1:])) for c in itertools.product((0, 1), repeat=len(y))]
            own = sum(z[i] for i in range(len(y)) if y[i]) + sum(transition[a, b] for a, b in zip(y, y[1:]))
            total += own - np.logaddexp.reduce(ways)
        return total / sum(len(y) for _, y in seqs)

    emission, transition = quality.fit_chain(seqs, np.zeros(3), steps=800, rate=0.05, decay=1e-2)
    theta = np.concatenate((emission, transition.ravel()))
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        slope = (likelihood((theta + step)[:3], (theta + step)[3:].reshape(2, 2)) - likelihood((theta - step)[:3], (theta - step)[3:].reshape(2, 2))) / 2e-5
        assert slope == pytest.approx(1e-2 * theta[k], abs=2e-3), "at the maximum the slope equals the decay"


def test_training_lines_are_bounded():
    assert quality.training_lines(512).tolist() == list(range(512))
    some = quality.training_lines(100_000)
    assert len(some) == 512 and some[0] == 0 and some[-1] == 99_999 and (np.diff(some) > 0).all()


def test_quality_of_odd_input(spark):
    docs = docs_of(spark, ODD + ["Fine words here.\nMore of them."])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = [r.score for r in quality.score_quality(docs, quality.train(docs, none)).collect()]
    assert len(scores) == len(ODD) + 1 and all(0 <= s <= 1 for s in scores)
    nulls = spark.createDataFrame([(None, 1, 0), (4, None, 0), (6, 1, 0), (7, 0, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, quality.train(docs, nulls)).collect())
    assert quality.keep_good(docs, nulls).columns == docs.columns
    assert quality.keep_good(docs.limit(0), nulls).count() == 0


# 4 packing, 6 tokens


def test_packing_is_a_round_trip(spark):
    rnd = random.Random(4)
    texts = [prose(rnd, rnd.randint(0, 900)) for _ in range(60)] + ODD + ["x" * 9000, "don't  stop\n\n now' 's"]
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    ids = {i: np.array(encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in enumerate(texts)}
    rows = sorted(packing.pack(docs_of(spark, texts).coalesce(2)).collect(), key=lambda r: (r.doc_id, r.start))
    at, used = dict.fromkeys(ids, 0), {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    padding = 0
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding < 0.05 * sum(at.values())
    assert packing.pack(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("capacity", [1, 64, 256, 511, 512, 4096])
def test_packing_into_other_capacities(spark, capacity):
    rnd = random.Random(capacity)
    texts = [prose(rnd, rnd.randint(0, 300), "") for _ in range(12)] + ["same words here."] * 3 + [None, "x" * 4000]
    rows = packing.pack(docs_of(spark, texts, [0] * 6 + list(range(6, len(texts)))).coalesce(1), capacity=capacity).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
        assert r.offset + r.length <= capacity and r.length > 0
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    assert sum(used.values()) == sum(len(encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(r.doc_id in (12, 13, 14) and r.start == 0 for r in rows) == 3, "repeated rows are packed each on its own"


def test_blocks_cost_hardly_more_than_one_programme(monkeypatch):
    rng = np.random.default_rng(3)
    ends = rng.random(50_300) < 0.02
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in rng.integers(1, 900, 2500)]
    counts = []
    for block in (10**9, packing.BLOCK):
        monkeypatch.setattr(packing, "BLOCK", block)
        packer = packing.Packer(ends, 2048, 0)
        rows = [r for i, d in enumerate(docs) for r in packer.add(i, d)] + packer.flush(True)
        assert sum(r[2] for r in rows) == sum(map(len, docs))
        counts.append(len({r[5] for r in rows}))
    assert counts[1] <= 1.01 * counts[0]


def test_ranks_that_differ_are_refused(tmp_path):
    lines = open(public_tokenizers.path(packing.RANKS), "rb").read().splitlines()
    at = tmp_path / "other.tiktoken"
    swapped = [*lines[:300], lines[301].split()[0] + b" 300", lines[300].split()[0] + b" 301", *lines[302:]]
    at.write_bytes(b"\n".join(swapped))
    with pytest.raises(ValueError):
        packing.compared(str(at), public_tokenizers.path("byte_bpe_50k.json"))


def test_best_cuts_equal_all_chains():
    rnd = random.Random(8)
    for _ in range(60):
        at = sorted(rnd.sample(range(1, 40), rnd.randint(3, 8)))
        at = [p for p in at] if all(b - a <= 16 for a, b in zip([0, *at], at)) else list(range(8, 49, 8))
        penalty = [rnd.randint(0, 9) for _ in at]
        pen = dict(zip(at, penalty))

        def cost(cuts):
            return sum(pen[c] + 16 - (c - b) for b, c in zip([0, *cuts], cuts))

        chains = (list(c) + [at[-1]] for k in range(len(at)) for c in itertools.combinations(at[:-1], k))
        best = min(cost(c) for c in chains if all(b - a <= 16 for a, b in zip([0, *c], c)))
        assert cost(packing.best_cuts(at, penalty, 16)) == best


def test_token_counts(spark):
    rnd = random.Random(6)
    alphabet = list(" \n\t▁aé漢\x00") + ["the", "ing", "<s>", "\U0001f600"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs_of(spark, texts), table_size=5).collect()}
    assert got == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts)}
    assert tokens.count_tokens(docs_of(spark, [])).count() == 0


def test_blobs_are_not_kept():
    lengths = tokens.Lengths(public_tokenizers.path(tokens.MODEL), {})
    blob = "q7" * 500
    assert lengths.count(blob) == len(lengths.model.encode(blob)) and max(map(len, lengths), default=0) <= tokens.LONG


# 5 personal data


def brute_spans(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111-1111 1111", "4785380592391139", "+1 (743) 555-3824", "+", "-", ".", " ", "é", "9", "0", "+12", "@@a.b", "00.1.02.255.7", "token=abc12345", "IBAN"]
    automaton = pii.anchors()
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        got = [(a, b, k) for a, b, k in pii.find(text, automaton) if k in pii.BASE_KINDS]
        assert got == [(a, b, name) for a, _, b, name in brute_spans(text)], text


def test_account_numbers_before_more_words():
    found = lambda t: [t[a:b] for a, b, k in pii.find(t, pii.anchors()) if k == "iban"]
    for number in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"):
        for cue in ("iban", "Iban"):
            assert [t for t in (f"{cue}: {number} x",) if [t[a:b] for a, b, k in pii.find(t, pii.anchors()) if k == "iban"] == [number]]
        for after in ("", " Bank", " OK THEN", " BIC COBADEFF", " 12 items", ".", " and"):
            assert found(f"IBAN {number}{after}") == [number], (number, after)
    assert found("IBAN DE89370400440532013001 Bank") == [] and found("IBAN DE8937040044053201300") == []


def test_redaction_and_odd_input(spark):
    docs = docs_of(spark, [*ODD, 'mail me@x.org, token = "abcdefgh1234", http://u:pw1@h.org/ IBAN GB82 WEST 1234 5698 7654 32'])
    out = {r.doc_id: r.text for r in pii.redact_documents(docs).collect()}
    assert out[0] is None and [out[i] for i in range(1, len(ODD))] == ODD[1:]
    assert out[len(ODD)] == 'mail <email>, token = "<secret>", http://<login>/ IBAN <iban>'
    assert pii.redact_documents(docs).columns == docs.columns
    assert pii.find_personal_data(docs_of(spark, [])).count() == 0


def test_personal_data_equals_its_sql_on_hard_texts(spark, tmp_path):
    numbers = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "NO9386011117947", "GB82 WEST 1234 5698 7654 32", "ZZ89370400440532013000", "FR1420041010050500013M02606"]
    texts = [f"{cue}{sep}{n}{after}" for n in numbers for cue, sep in (("IBAN", " "), ("iban", ": "), ("Iban", "")) for after in ("", " OK THEN", " IBAN NO9386011117947", "é x@y.zz")]
    texts += ["IBAN IBAN DE89370400440532013000", "xIBAN", "IBAN DE89", *[t for t in ODD if t is None or "\x00" not in t], "token=abc12345 password: 'hunter2222'", "http://u:p@h.org/ +1 (743) 555-3824"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    path = next((tmp_path / "documents.parquet").glob("*.parquet"))
    (tmp_path / "flat").mkdir()
    path.rename(tmp_path / "flat" / "documents.parquet")
    assert_same(queries()["op5_pii"], oracle_sql()["op5_pii"], spark, str(tmp_path / "flat"))


# 7 urls, 8 licences


def test_url_rules_and_links(spark):
    link = '<a href="//bad.net/x">'
    rows = [(1, "HTTP://A.B.Example.ORG/es/x?q#f", None, 0), (2, "http://x.com", link, 0), (3, None, link, 0), (4, "no url", "", 0), (5, "ftp://COM/de/", link, 0), (6, "http://bad.net/de", "<a href='https://com/z'>", 0), (7, "http://good.net/", "<a href=http://x.org/>", 0), (8, "http://example.org/en/12", None, 0), (8, "http://example.org/en/12", None, 0), (9, "http://x.org/", '<a href="http://good.net/">', 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert got[1] == ("a.b.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("x.com", "", None, "block"), "its link's target links to a blocked host"
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5] == ("com", "/de/", "com/de/", "block")
    assert got[6][3] == "block", "it links to a blocked host"
    assert got[7][3] == "allow" and got[8][2] == "example.org/en/1"
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_url_ranks_equal_iteration(spark):
    rnd = random.Random(7)
    hosts = [f"h{i}" for i in range(8)]
    links = {(a, b): rnd.randint(1, 3) for a in hosts for b in hosts if a != b and rnd.random() < 0.3}
    seeds = {"h0": (3.0, 0.0), "h1": (0.0, 2.0), "h2": (1.0, 1.0)}
    ranks = urls.propagate(spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "src string, dst string, n long"), iterations=6, tolerance=-1)
    got = {r.host: (r.trust, r.distrust) for r in ranks.collect()}
    for k in (0, 1):
        edges = {(a, b) if k == 0 else (b, a): n for (a, b), n in links.items()}
        base = {h: 0.15 * seeds.get(h, (0, 0))[k] for h in hosts}
        rank = dict(base)
        for _ in range(6):
            out = {a: sum(n for (x, _), n in edges.items() if x == a) for a in hosts}
            rank = {h: base[h] + 0.85 * sum(rank[a] * n / out[a] for (a, b), n in edges.items() if b == h) for h in hosts}
        assert {h: pytest.approx(rank[h]) for h in hosts if h in got} == {h: v[k] for h, v in got.items()}


def test_pages_with_a_hub_equal_a_plain_version(spark):
    """A generated web: one host links to and from half of all, chains of twenty hosts lead to blocked and allowed ones."""
    rnd = random.Random(20)
    hosts = [f"h{i}.net" for i in range(40)]
    pages = [("hub.net", h) for h in hosts[:20]] + [(h, "hub.net") for h in hosts[:20]] + [(f"c{i}.net", f"c{i + 1}.net") for i in range(20)] + [("c20.net", "example.org"), ("a.org", "h3.net"), ("b.com", "h4.net"), ("h30.net", "b.com")]
    pages += [(rnd.choice(hosts), rnd.choice(hosts)) for _ in range(60)]
    path = {"example.org": "/es/", "b.com": "/de/x", "a.org": "/"}
    rows = [(i, f"http://{a}{path.get(a, '/p')}", f"<p><A class=x HREF='https://{b}/q'>x</a><a href=/inner>") for i, (a, b) in enumerate(pages)] + [(900, "http://example.org/es/", None), (901, "http://c0.net", "<a " * 2000)]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    links, seeds = {}, {}
    for a, b in pages:
        if a != b:
            links[a, b] = links.get((a, b), 0) + 1
    for _, url, _ in rows:
        h = url.split("/")[2]
        if h in path:
            t, d = seeds.get(h, (0, 0))
            seeds[h] = (t + (h == "a.org"), d + (h != "a.org"))
    ranks = []
    for k in (0, 1):
        edges = {(a, b) if k == 0 else (b, a): n for (a, b), n in links.items()}
        base = {h: 0.15 * v[k] for h, v in seeds.items()}
        out, rank = {}, dict(base)
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        for _ in range(200):
            new = dict(base)
            for (a, b), n in edges.items():
                new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * n / out[a]
            rank = new
        ranks.append(rank)
    for i, url, _ in rows:
        h = url.split("/")[2]
        t, d = ranks[0].get(h, 0), ranks[1].get(h, 0)
        if h in path:
            assert got[i] == ("allow" if h == "a.org" else "block")
        elif abs(t - d) > 1e-5:
            assert got[i] == ("block" if d > t else "allow"), (h, t, d)
    assert got[901] == "block" and any(v == "block" for v in got.values()) and any(v == "allow" for v in got.values())


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [(1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/x.c", "int main;"), (3, "p/a/b/LICENCE.txt", "Licensed under the Apache License, Version 2.0."), (4, "p/a/b/y.c", None), (5, "p/a/bb/z.c", ""), (6, "q/w.c", "code"), (7, None, "code"), (8, "p/a/v.c", "// Licensed under CC BY-NC 4.0.\n" + "word " * 50), (9, "p/a/u.c", "a license plate"), (10, "top.c", "x")]
    got = {r.row_id: (r.licence, r.origin) for r in licences.scan_licences(spark.createDataFrame(rows, "row_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: ("Apache-2.0", "inherited"), 5: ("MIT", "inherited"), 6: (None, None), 7: (None, None), 8: ("CC-BY-NC-4.0", "own"), 9: ("MIT", "inherited"), 10: (None, None)}
    assert licences.scan_licences(spark.createDataFrame([], "row_id long, path string, text string")).count() == 0


def wrapped(text, mark, width=60):
    return "\n".join(mark + x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width), ""])


def test_real_licence_files_and_headers(spark):
    whole = {p.stem: p.read_text() for p in (pathlib.Path(licences.__file__).parent / "licence_texts").glob("*.txt")}
    mit = whole["MIT"].replace("<year> <copyright holders>", "2021 Some Body and others")
    gpl = next(t for n, t in licences.STATEMENTS if n == "GPL-3.0" and "redistribute" in t)
    apache = next(t for n, t in licences.STATEMENTS if n == "Apache-2.0" and "compliance" in t)
    rows = [
        (1, "a/LICENSE", wrapped(mit, "")), (2, "b/LICENSE.txt", whole["Apache-2.0"]), (3, "c/COPYING", whole["GPL-2.0"]), (4, "d/COPYING", whole["GPL-3.0"]), (5, "e/LICENSE", whole["BSD-2-Clause"]),
        (6, "f/LICENSE", whole["GPL-3.0"].replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL")),
        (10, "s/x.c", "/*\n" + wrapped("Foo, a program.\n\n" + gpl, " * ") + "\n */\nint main() {}\n" * 40), (11, "s/y.py", wrapped(apache, "# ") + "\nimport os\n" * 40),
        (12, "s/z.js", "// SPDX-License-Identifier: BSD-3-Clause\nlet x = 1\n"), (13, "s/w.rs", "// " + "\n// ".join(textwrap.wrap(mit, 70)) + "\nfn main() {}"), (14, "n/v.go", "package license\n// a license for boats\n"),
        (20, "a/b/c/d.c", "x"), (21, "a/b/LICENSE", "no cue at all"), (22, "a/b/c2/LICENSE", whole["ISC"]), (23, "a/b/c2/d/e.c", None), (24, "zz/LICENSE", None),
    ]
    got = {r.row_id: (r.own_licence, r.licence) for r in licences.scan_licences(spark.createDataFrame(rows, "row_id long, path string, text string")).collect()}
    own = {1: "MIT", 2: "Apache-2.0", 3: "GPL-2.0", 4: "GPL-3.0", 5: "BSD-2-Clause", 6: "AGPL-3.0", 10: "GPL-3.0", 11: "Apache-2.0", 12: "BSD-3-Clause", 13: "MIT", 22: "ISC"}
    assert {k: v[0] for k, v in got.items() if v[0]} == own
    assert got[20] == (None, "MIT") and got[21] == (None, "MIT"), "inherited over two and one levels"
    assert got[23] == (None, "ISC") and got[24] == got[14] == (None, None)


def test_repeated_licence_rows_are_judged_alone(spark):
    line = "Released under the MIT License."
    few = "p/x.c", line + "\n" + " word" * 100
    rows = [(1, *few), (2, "p/y.c", "code")]
    many = [*rows, *[(1, *few)] * 20, (None, "q/z.c", line), (None, "q/w.c", "code"), (None, None, line), (5, "r/a.c", line), (5, "t/b.c", "other code")]
    scan = lambda r: sorted((x.row_id or 0, x.path or "", x.licence or "", x.origin or "") for x in licences.scan_licences(spark.createDataFrame(r, "row_id long, path string, text string")).collect())
    assert scan(rows) == [(1, "p/x.c", "MIT", "own"), (2, "p/y.c", "", "")]
    got = scan(many)
    assert got.count((1, "p/x.c", "MIT", "own")) == 21 and (2, "p/y.c", "", "") in got and len(got) == len(many)
    assert {(0, "q/z.c", "MIT", "own"), (0, "q/w.c", "MIT", "inherited"), (0, "", "MIT", "own"), (5, "r/a.c", "MIT", "own"), (5, "t/b.c", "", "")} <= set(got)


# 9 near-duplicates


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_banded_distances_equal_the_full_matrix():
    rnd = random.Random(9)
    a, b = [], []
    for _ in range(150):
        x = [rnd.randint(0, 30) for _ in range(rnd.randint(0, 60))]
        y = list(x)
        for _ in range(rnd.randint(0, 20)):
            i = rnd.randint(0, len(y))
            y[i : i + rnd.randint(0, 2)] = [rnd.randint(0, 30)] * rnd.randint(0, 2)
        a.append(np.array(x, np.int64))
        b.append(np.array(y, np.int64))
    limit = np.array([int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)])
    want = np.array([edit_distance(x.tolist(), y.tolist()) for x, y in zip(a, b)])
    assert (near_text.edit_distances(a, b, limit) == np.minimum(want, limit + 1)).all()


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(10)
    texts = []
    for _ in range(25):
        base = prose(rnd, rnd.randint(40, 150)).split()
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(max(1, len(base) // 60)):
                copy[rnd.randrange(len(copy))] = "edit" + str(rnd.randint(0, 9))
            texts.append(" ".join(copy))
    passage = prose(rnd, 60)
    texts += [passage + " " + prose(rnd, 80) for _ in range(20)] + [texts[0], texts[0] + "\n", *ODD]
    w = [repeats.words_of(t) for t in texts]
    near = {(i, j) for i, j in itertools.combinations(range(len(w)), 2) if w[i] and w[j] and edit_distance(w[i], w[j]) <= int(0.2 * max(len(w[i]), len(w[j])) + 1e-9)}
    group = list(range(len(w)))
    for i, j in sorted(near) * 3:
        group[i] = group[j] = min(group[i], group[j])
    got = near_text.near_documents(docs_of(spark, texts)).collect()
    assert {r.doc_id: r.group_id for r in got} == dict(enumerate(group))
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)
    kept = near_text.keep_one(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group)) and kept.columns == docs_of(spark, []).columns
    assert near_text.near_documents(docs_of(spark, [])).count() == 0


def test_near_pairs_in_a_bucket_of_unlike_texts(spark):
    rnd = random.Random(12)
    own = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passage, texts, pairs = own(300), [], 60
    for _ in range(pairs):
        x = own(80)
        y = list(x)
        for at in rnd.sample(range(80), 12):
            y[at] = own(1)[0]
        texts += [" ".join(passage + x), " ".join(passage + y)]
    group = {r.doc_id: r.group_id for r in near_text.near_documents(docs_of(spark, texts)).collect()}
    assert group == {i: i - i % 2 for i in range(2 * pairs)}


@pytest.mark.parametrize("case", [(100, 19, 0), (120, 18, 60), (380, 40, 300)])
def test_recall_over_the_whole_definition(spark, case):
    found, all_of_them = near_recall.recall(spark, case, 150)
    assert found >= 0.9 * all_of_them


@pytest.mark.parametrize("case", [(10, 2, 0), (20, 4, 0), (25, 5, 0), (30, 6, 0), (50, 10, 0), (5, 1, 0), (96, 19, 0)])
def test_short_texts_all_meet(spark, case):
    found, all_of_them = near_recall.recall(spark, case, 100)
    assert found == all_of_them


@pytest.mark.parametrize("sharing", [near_text.SMALL, near_text.SMALL + 2])
def test_pairs_in_buckets_under_and_over_the_size_that_aligns_all(spark, sharing):
    found, all_of_them = near_recall.recall(spark, (120, 18, 60, sharing), 9 * sharing)
    assert found >= 0.97 * all_of_them


@pytest.mark.parametrize("case", [(120, 18, 60, 18), (120, 24, 60, 40)])
def test_no_near_pair_of_a_large_bucket_is_lost(spark, case):
    found, all_of_them = near_recall.recall(spark, case, 243)
    assert found == all_of_them


def test_groups_of_a_large_bucket_are_joined_by_few_pairs(spark, monkeypatch):
    text = list(range(100))
    texts = {0: list(range(500, 600))} | {k: text[:k] + [1000 + k] + text[k + 1 :] for k in range(1, 41)}
    texts[41] = text[:10] + list(range(700, 790))  # shares a few words only
    rows = [(1, k, 0, 42) for k in range(42)] + [(2, k, 1, 20) for k in range(1, 21)] + [(3, k, 21, 20) for k in range(21, 41)]
    rows = near_text.stored(spark.createDataFrame(rows, "key long, rep long, centre long, n long"))
    words = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in texts.items()], "doc_id long, words binary")
    counts, align = [], near_text.aligned

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return align(pairs, *rest)

    monkeypatch.setattr(near_text, "aligned", counted)
    groups = {r.node: r.component for r in near_text.components(near_text.near_links(rows, words, 0.8)).collect()}
    assert groups == dict.fromkeys(range(1, 41), 1)
    assert sum(counts[1:]) < 10  # two groups of 20 have 400 pairs


@pytest.mark.parametrize("large", [near_text.LARGE, near_text.SMALL])
def test_large_buckets_are_exact_by_keys_and_by_rare_words(spark, monkeypatch, large):
    monkeypatch.setattr(near_text, "LARGE", large)
    monkeypatch.setattr(near_text, "BLOCK", 8)
    found, all_of_them = near_recall.recall(spark, (120, 24, 60, 40), 120)
    assert found == all_of_them


def test_crowd_pairs_hold_every_near_pair_of_different_stars(spark):
    rnd = random.Random(22)
    rows = []
    for k in range(60):  # few words, so that most are frequent; every third text is an edited one of those before
        x = [rnd.randrange(40) for _ in range(rnd.randrange(1, 40))] if k % 3 or not rows else list(rnd.choice(rows)[2])
        for _ in range(rnd.randrange(len(x) // 5 + 2) if k % 3 == 0 else 0):
            x[rnd.randrange(len(x)) :][:1] = [rnd.randrange(40)]
            x[rnd.randrange(len(x))] = rnd.randrange(40)
        rows.append((k, k // 2, x))
    crowd = spark.createDataFrame([(k, star) for k, star, _ in rows], "rep long, star long")
    words = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, _, x in rows], "doc_id long, words binary")
    got = {(r.rep, r.centre) for r in near_text.crowd_pairs(crowd, words, 0.8).collect()}
    near = set()
    for (j, s, x), (k, t, y) in itertools.combinations(rows, 2):
        limit = np.array([max(len(x), len(y)) // 5])
        if s != t and near_text.edit_distances([np.array(x)], [np.array(y)], limit)[0] <= limit[0]:
            near.add((k, j))
    assert near and near <= got and len(got) < len(rows) * (len(rows) - 1) // 4


def test_short_runs_are_shared_by_every_near_pair():
    rnd = random.Random(21)
    for n in range(4, 101):
        for _ in range(20):
            x = [rnd.randrange(10**9) for _ in range(n)]
            y = list(x)
            for _ in range(n // 5):  # an edit: another word, one less, or one more if the text may still grow
                at = rnd.randrange(len(y))
                if rnd.random() < 0.4:
                    y[at] = rnd.randrange(10**9)
                elif rnd.random() < 0.5:
                    del y[at]
            a, b = (near_text.keys_of(repeats.mixed(np.array(w, np.uint64))) for w in (x, y))
            if n >= 5:
                assert set(a.tolist()) & set(b.tolist())


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(16)
    base = [f"w{rnd.randrange(10**9)}" for _ in range(100)]
    texts = []
    for _ in range(400):
        copy = list(base)
        for at in rnd.sample(range(100), 9):
            copy[at] = f"e{rnd.randrange(10**9)}"
        texts.append(" ".join(copy))
    assert {r.group_id for r in near_text.near_documents(docs_of(spark, texts)).collect()} == {0}


def test_bucket_rows_grow_in_proportion(spark, monkeypatch):
    """Texts that share one passage: a class has no more rows at a level than first keys, however many share it."""
    rnd, counts = random.Random(17), {}
    passage = [f"p{i}" for i in range(60)]
    split = near_text.buckets
    for n in (200, 600):
        texts, rows = [" ".join(passage + [f"w{rnd.randrange(10**9)}" for _ in range(60)]) for _ in range(n)], []

        def counted(df, rows=rows):
            out = split(df)
            rows.append(out.count())
            return out

        monkeypatch.setattr(near_text, "buckets", counted)
        assert near_text.near_documents(docs_of(spark, texts)).where("not kept").count() == 0
        counts[n] = rows
        assert all(x <= n * near_text.ORDERS * near_text.LEAST * (near_text.LEAST - 1) // 2 for x in rows) and len(rows) <= 5
    assert sum(counts[600]) <= 5 * sum(counts[200])


def test_near_duplicates_of_odd_ids(spark):
    rnd = random.Random(18)
    text, long = prose(rnd, 60), " ".join(f"w{rnd.randrange(10**9)}" for _ in range(30_000))
    texts, ids = [text, text, text + " more", prose(rnd, 50), long, long + " end", text, text + " more"], [None, None, None, 4, 5, 6, 7, 7]
    got = sorted((r.doc_id or 0, r.group_id or 0, r.kept) for r in near_text.near_documents(docs_of(spark, texts, ids)).collect())
    assert got == sorted([(0, 7, True)] * 3 + [(4, 4, True), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True)])


# 10 decontamination


def test_blocks_of_windows_change_nothing(spark, data_dir):
    docs, bench = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(str, decontaminate.find_benchmark(docs, bench, max_windows=n).collect())) for n in (10**6, 100))
    assert one == many


def test_benchmark_passages_go_and_clean_documents_stay(spark):
    rnd = random.Random(11)
    item, short = prose(rnd, 30, ""), "Four Words Only Here"
    clean = [prose(rnd, 60) for _ in range(5)]
    texts = [*clean, clean[0] + " " + item.upper() + " " + clean[1], item, "x four, WORDS only... here y " + clean[2], *ODD]
    bench = spark.createDataFrame([(7, item, 1), (8, short, 1), (9, None, 1), (10, "", 1), (11, "...", 1)], "item_id long, text string, n_words int")
    found = {r.doc_id: (r.n_words, sum(x.end - x.start for x in r.ranges), list(r["items"])) for r in decontaminate.find_benchmark(docs_of(spark, texts), bench).collect()}
    assert found[5][1:] == (30, [7]) and found[6] == (30, 30, [7]) and found[7][1:] == (4, [8])
    assert all(found[i][1] == 0 for i in range(5)) and found[8] == (0, 0, [])
    out = {r.doc_id: r.text for r in decontaminate.remove_benchmark(docs_of(spark, texts), bench).collect()}
    assert 6 not in out and all(out[i] == texts[i] for i in [*range(5), *range(8, len(texts))])
    assert item.upper() not in out[5] and clean[1] in out[5] and len(out) == len(texts) - 1
    assert decontaminate.find_benchmark(docs_of(spark, []), bench).count() == 0
    assert all(r.ranges == [] for r in decontaminate.find_benchmark(docs_of(spark, texts), bench.limit(0)).collect())


def test_blocks_are_cut_and_judged_together(spark):
    rnd = random.Random(13)
    own = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    w, u, x, y, split = own(27), own(20), own(40), own(40), own(18)
    items = [w[:20], w[15:], split, u]
    # overlapping items; two items that are over half together only; words that a cut makes neighbours
    texts = [" ".join(t) for t in (x + w + y, w[:20] + x[:30] + u, x + split[:9] + w[:20] + split[9:] + y)]
    bench = spark.createDataFrame([(i, " ".join(t), 1) for i, t in enumerate(items)], "item_id long, text string, n_words int")
    for n in (10**6, 11):
        out = {r.doc_id: r.text for r in decontaminate.remove_benchmark(docs_of(spark, texts), bench, max_windows=n).collect()}
        assert {k: t.split() for k, t in out.items()} == {0: x + y, 2: x + split + y}


def test_items_without_an_id_are_found_but_not_named(spark):
    rnd = random.Random(19)
    w = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(None, " ".join(w[:20])), (3, " ".join(w[5:25])), (None, "lone"), (3, " ".join(w[5:25])), (None, None)], "item_id long, text string")
    texts = [" ".join(w), prose(rnd, 20), "a lone word", None]
    for n in (10**6, 4):
        got = {r.doc_id: ([(x.start, x.end) for x in r.ranges], list(r["items"])) for r in decontaminate.find_benchmark(docs_of(spark, texts), bench, max_windows=n).collect()}
        assert got == {0: ([(0, 25)], [3]), 1: ([], []), 2: ([(1, 2)], []), 3: ([], [])}
        assert {r.doc_id: r.text for r in decontaminate.remove_benchmark(docs_of(spark, texts), bench, max_windows=n).collect()} == {1: texts[1], 2: "a  word", 3: None}


def test_windows_are_counted_by_words_not_spaces(spark):
    item = "\n".join(f"w{i}" for i in range(500))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    count, first = next(decontaminate.blocks_of(bench, 10, 100, "item_id", "text"))
    assert count == 5 and len(first["windows"]) < 200


# pipeline


def test_pipeline_of_odd_rows(spark, data_dir, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, rep string, key long, _row int, n int"
    texts = [*ODD, "Fine words stand here. More of them follow.", "Fine words stand here. More of them follow.", "word " * 30_000]
    docs = spark.createDataFrame([(None if i == 2 else i, t, None, None, None, "x", 1, 2, 3) for i, t in enumerate(texts)], kinds)
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{data_dir}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {len(ODD)} <= {r.doc_id for r in rows} and len(ODD) + 1 not in {r.doc_id for r in rows}


# pipeline by brute force


def plain_near_kept(texts):
    """Ids of the first text of each group of near texts: all pairs, by the whole alignment matrix, a row at a time."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    names = {w: k for k, w in enumerate({w for v in words.values() for w in v})}
    w = {i: np.array([names[x] for x in v]) for i, v in words.items() if v}
    counts = {i: np.bincount(v, minlength=len(names)) for i, v in w.items()}
    first = {i: i for i in texts}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, j in itertools.combinations(sorted(w), 2):
        a, b = w[i], w[j]
        most = int(0.2 * max(len(a), len(b)) + 1e-9)
        lacks = counts[i] - counts[j]
        if abs(len(a) - len(b)) > most or max(lacks[lacks > 0].sum(), -lacks[lacks < 0].sum()) > most:
            continue
        ramp = np.arange(len(b) + 1)
        row = ramp
        for x in a:
            row = np.minimum.accumulate(np.concatenate(([row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (b != x)))) - ramp) + ramp
        if row[-1] <= most:
            lo, hi = sorted((root(i), root(j)))
            first[hi] = lo
    return {i for i in texts if root(i) == i}


def test_pipeline_equals_its_stages_by_brute_force(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    field = quality.train(docs, labels)
    left = {r.doc_id: r.text for r in docs.collect() if field.score(r.text) >= quality.THRESHOLD}
    good = {r.doc_id for r in labels.collect() if r.quality}
    assert good <= set(left)
    kept = plain_near_kept(left)
    assert len(kept) < len(left)
    left = {i: t for i, t in left.items() if i in kept}
    bench = decontaminate.windows_of([(r.item_id, r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()], 10)
    left = {i: decontaminate.without_ranges(t, bench) if t else t for i, t in left.items()}
    automaton = pii.anchors()
    left = {i: pii.redact(t, pii.find(t, automaton)) for i, t in left.items() if t is not None}
    encode = packing.Ids(public_tokenizers.path(packing.RANKS)).encode
    want = {i: len(encode(t)) for i, t in left.items()}
    got = {}
    for r in corpus_pipeline.run(spark, data_dir).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
