"""Each corpus operator on small tables with nulls, empty texts, ties, repeats and clashing columns, against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import brown_lm, chat_format, decontaminate, html_extract, jaccard_join, line_dedup, mixing, quality, secret_scan, shingling, token_store
from sluice.llm.queries import tokenizer_path

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n long, size long"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sentence(k, n=60):
    return " ".join(f"w{(k * 7919 + i * i * 31) % 997}" for i in range(n))


TEXTS = [None, "", " \n\t ", "one two", "one two", sentence(1), sentence(1), sentence(1) + " tail", sentence(2, 300), "x\n" + sentence(3) + "\nx\nx", "Pass " + sentence(4, 40) + ". " + sentence(9, 45) + ".", sentence(5, 30) + ". " + sentence(9, 45) + ".", "# $ % & " * 30, "naïve café " * 40, "password=abc123def and token: x AKIA" + "A" * 16 + " " + "0f" * 14, sentence(6, 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "b", "a", "é"][i % 4], 0, "r", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "null id " * 5, "en", "a", 0, "r", 1, 2)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, none):
    got = {(r.doc_id, r.n_deleted): r.text for r in line_dedup.deduped(docs).collect()}
    assert got[(0, 0)] is None and got[(1, 0)] == ""
    assert [k for k in got if k[0] == 6][0][1] == 1 and got[(6, 1)] == ""
    assert got[(10, 0)] == TEXTS[10] and got[(11, 1)] == sentence(5, 30) + ". "
    assert line_dedup.deduped(none).count() == 0


def _scattered(k, apart):
    """Four 16-word lines as one passage, or with other lines in between."""
    ls = [f"{sentence(50 + j, 16)}." for j in range(4)]
    return " ".join(x for j, y in enumerate(ls) for x in ([f"{sentence(1000 + 10 * k + j, 16)}.", y] if apart else [y]))


def deleted_by_brute_force(rows, min_words=30):
    """Lines deleted of each row: all equal runs of enough words with any earlier place."""
    keyed = sorted((-1 if i is None else i, t) for i, t in rows)
    cut = [[x.strip() for x in re.split(line_dedup.BREAK, t)] for _, t in keyed]
    out = []
    for b in range(len(cut)):
        gone = set()
        for a in range(b + 1):
            if a < b and keyed[a] == keyed[b]:
                continue
            for d in range(1 if a == b else -len(cut[a]), len(cut[b])):
                run = []
                for j in range(len(cut[b]) + 1):
                    if j < len(cut[b]) and 0 <= j - d < len(cut[a]) and cut[a][j - d] == cut[b][j]:
                        run.append(j)
                        continue
                    if sum(len(cut[b][x].split()) for x in run) >= min_words:
                        gone |= set(run)
                    run = []
        out.append((keyed[b][0], len(gone)))
    return sorted(out)


def test_line_dedup_behind_scattered_lines(spark):
    """A passage is found in a third document though the first one holds its lines scattered."""
    rows = [(1, _scattered(1, True)), (2, _scattered(2, False)), (3, _scattered(3, False))]
    got = {r.doc_id: r.n_deleted for r in line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 4}


def test_line_dedup_against_all_earlier_places(spark):
    import random

    rng = random.Random(5)
    pool = ["", "", "a.", "b c.", *[f"{sentence(k, 7 + 3 * k)}." for k in range(6)]]
    rows = [(rng.choice([None, *range(30)]), "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for _ in range(40)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_deleted) for r in line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == deleted_by_brute_force(rows) and sum(n for _, n in got) > 20


def test_line_dedup_within_a_document(spark):
    """A passage is found again though its lines stand scattered between its two places."""
    text = " ".join([_scattered(0, False), _scattered(1, True), _scattered(0, False)])
    got = line_dedup.deduped(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_deleted == 4 and len(got.text.split()) == 4 * 16 * 3


def test_line_dedup_works_by_lines(spark):
    """Finding windows costs little beside cutting and hashing lines, however many words they have."""
    import time

    from pyspark.sql import functions as F

    base = spark.range(0, 400, 1, 2).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 250), i -> concat(repeat('a ', 29), id, 'x', i)), '\n')").alias("text")).cache()
    assert base.count() == 400
    cut = base.select(F.transform(F.split("text", line_dedup.BREAK_OUT), lambda x: F.struct(F.xxhash64(F.trim(x)), F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))))).alias("x"))

    def least(df):
        took = []
        for _ in range(7):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    assert least(line_dedup._hashed(base, 30)) < 2.5 * least(cut)


def test_line_dedup_lines_without_words(spark):
    """Blank lines take the other way through the windows: the same passages go, with and without them, and short rows stay."""
    one, two = [f"{sentence(70 + k, 12)} {k}." for k in range(5)], [f"{sentence(80 + k, 13)} {k}." for k in range(3)]
    rows = [(1, "\n".join(one)), (2, "\n".join(["own start", *one, *two])), (3, "\n".join(["other", "", *one, " ", *two, "\t"])), (4, "\n".join(two)), (5, one[0]), (6, ""), (7, "\n\n")]
    got = {r.doc_id: (r.n_lines, r.n_deleted) for r in line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (5, 0), 2: (9, 5), 3: (12, 8), 4: (3, 3), 5: (1, 0), 6: (1, 0), 7: (3, 0)}


def test_token_store(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = token_store.stored(docs, tokenizer_path(), str(tmp_path / "s")).orderBy("start").collect()
    assert len(got) == docs.count() and got[0].doc_id is None
    start = 0
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        ids = [*t.encode(text[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    back = {r.start: r.ids for r in token_store.read_ids(spark, str(tmp_path / "s")).collect()}
    assert sum(map(len, back.values())) == start
    assert token_store.stored(none, tokenizer_path()).count() == 0
    e = token_store.Encoder(tokenizer_path())
    for x in ["a  b", " a", "a ", "  a\n b  \n\n c", "don't we'll", "x \n y", "  a　b", "<|endoftext|> a", "x  <|endoftext|>  y <|endoftext|><|endoftext|>z", "it's<|endoftext|>'s", "1 2  3\t4", "日本 語。  x"]:
        assert np.frombuffer(e(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_token_store_learns_pieces_in_bulk(monkeypatch):
    """New pieces, as most are in noisy text, cost fewer Python calls than there are pieces; ids are the library's."""
    import random
    import sys

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgéßx,.'1", k=r.randint(1, 12))) for _ in range(20_000)]
    odd = ["<|endoftext|>", "x<|endoftext|>y", "<|endof", "text|>", "é" * 400, "z1" * 300, "'s", "a\n", "\nb", "日本語。"]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(80)] + [" ".join(r.choices(odd + words[:50], k=60)) for _ in range(40)] + ["", " ", "a", *odd]
    raw = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    monkeypatch.setattr(token_store, "SLOTS", 1 << 15)  # pieces meet in slots
    for most in (token_store.MAX_PIECES, 17_000):  # with the table emptied in between, too
        monkeypatch.setattr(token_store, "MAX_PIECES", most)
        e = token_store.Encoder(tokenizer_path())
        for a, b in ((0, 60), (60, len(raw)), (0, len(raw))):
            calls = 0

            def count(frame, event, arg):
                nonlocal calls
                calls += event in ("call", "c_call")

            data, before = np.frombuffer(b"".join(raw), np.uint8), e.n_pieces
            sys.setprofile(count)
            try:
                ids, counts = e.encode(data, offsets[a : b + 1])
            finally:
                sys.setprofile(None)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[a:b]
            if not before:
                assert e.n_pieces > 10_000 and calls < e.n_pieces


def test_famous_passage(spark):
    """A passage in more places than a task should see, beside a rare one: the first places stay."""
    famous, rare = sentence(60, 40) + ". ", sentence(61, 35) + ". "
    rows = [(k, f"{' '.join(f'u{k}x{i}' for i in range(20))}. {famous}{rare if k in (700, 900) else ''}End {k}.") for k in range(1500)]
    got = {r.doc_id: r.n_deleted for r in line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {k: 0 if k == 0 else 2 if k == 900 else 1 for k in range(1500)}


def test_mixing(docs, none):
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count()
    per = collections.defaultdict(list)
    for r in got:
        assert r.taken <= 2 * r.size
        per[r.source].append(r)
    total = sum(r.size for r in got)
    assert math.isclose(sum(v[0].target for v in per.values()), 1.5 * total, rel_tol=1e-9)
    for rows in per.values():
        assert sum(r.size for r in rows) == rows[0].source_size
        assert rows[0].target - sum(r.taken for r in rows) <= max(r.size for r in rows) and sum(r.taken for r in rows) <= rows[0].target + 1e-6
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.mixed(docs).collect())
    assert mixing.mixed(none).count() == 0


def test_mix_stage_with_repeated_ids(spark):
    """Rows of one doc_id with different sizes, and rows without an id, each stand as often as they were drawn."""
    import corpus_pipeline

    rows = [(i, sentence(k, n), "a") for k, (i, n) in enumerate([(1, 20), (1, 300), (1, 3000), (None, 50), (None, 700), *[(i, 90) for i in range(2, 12)]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = collections.Counter()
    for r in mixing.mixed(df).collect():
        want[r.doc_id, r.size] += r.copies
    got = collections.Counter((r.doc_id, len(r.text.split())) for r in corpus_pipeline.source_mix(spark, df, "").collect())
    assert got == +want and max(got[1, n] for n in (20, 300, 3000)) <= 2


def mixed_by_brute_force(rows):
    """Copies of rows (doc_id, source, size) by the rules of the mix, one source after the other."""
    total = collections.Counter()
    for _, source, size in rows:
        total[source] += size
    order = sorted(total, key=lambda x: (x is None, x or ""))
    weight = {x: (3, 1, 2)[k % 3] for k, x in enumerate(order)}
    goal, full = {}, set()
    while True:  # targets above the cap are cut, and what is over is shared again
        left = 1.5 * sum(total.values()) - sum(2 * total[x] for x in full)
        goal = {x: 2.0 * total[x] if x in full else left * weight[x] / sum(weight[y] for y in order if y not in full) for x in order}
        over = {x for x in order if x not in full and goal[x] > 2 * total[x] + 1e-9}
        if not over:
            break
        full |= over
    out = []
    for x in order:
        mine = [(i, n) for i, s, n in rows if s == x]
        words = collections.Counter()
        for _, n in mine:
            if n:
                words[n.bit_length()] += n
        lo, hi = 0.0, 3.0
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(w * min(2, c * (k + 1)) for k, w in words.items()) < goal[x] else (lo, c)
        drawn, whole, rank = {}, {}, {}
        for j, (i, n) in enumerate(mine):
            copies = min(2, hi * (n.bit_length() + 1)) if n else 0
            whole[j] = math.floor(copies + 1e-9)
            p = copies - whole[j]
            u = (int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            if p > 1e-9:
                rank[j] = math.log2(u / (1 - u) * (1 - p) / p)
        room = goal[x] - sum(whole[j] * n for j, (_, n) in enumerate(mine))
        for _ in range(2):
            used = 0
            for j in sorted((j for j in rank if j not in drawn and mine[j][1] <= room), key=lambda j: (rank[j], mine[j][0])):
                if used + mine[j][1] > room:
                    break
                used += mine[j][1]
                drawn[j] = 1
            room -= used
        out += [(i, x, n, whole[j] + drawn.get(j, 0)) for j, (i, n) in enumerate(mine)]
    return out


def test_mixing_by_brute_force(spark):
    r = np.random.default_rng(8)
    for shares in ([0.7, 0.1, 0.1, 0.1], [0.02, 0.9, 0.04, 0.04], [0.25] * 4):
        rows = [(k, [None, "b", "a", "é"][r.choice(4, p=shares)], int(r.exponential(40)) if k % 9 else 0) for k in range(400)]
        df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, s, n in rows], "doc_id long, text string, source string").repartition(3)
        got = collections.Counter((x.doc_id, x.source, x.size, x.copies) for x in mixing.mixed(df).collect())
        assert got == collections.Counter(mixed_by_brute_force(rows))


def test_brown(docs, none):
    got = brown_lm.scored(docs).collect()
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tok = lambda t: [*W.findall(low(t)), None]
    c = collections.Counter(w for r in rows if not held(r.doc_id) for w in tok(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), len(tok(r.text)), sum(c[w] > 0 for w in tok(r.text)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(r.text)), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and r.held_out == held(r.doc_id) for r in got)
    assert brown_lm.scored(none).count() == 0


def test_brown_model_by_brute_force(monkeypatch):
    """Few items, so most words are clustered by their own contexts: classes, sums to one and scores against plain counts."""
    for name, value in {"FREQUENT": 8, "SIGNATURES": 4, "CLASSES": 3, "END": 12, "ITEMS": 13, "N_CLASSES": 4}.items():
        monkeypatch.setattr(brown_lm, name, value)
    r = np.random.default_rng(4)
    words = [f"w{k}" + "x" * (k % 4) for k in range(40)]
    texts = [" ".join(words[min(39, int(r.exponential(9)))] for _ in range(r.integers(0, 60))) for _ in range(60)] + ["unseen w0 Never-seen w1x"]
    held = [k % 7 == 2 for k in range(60)] + [True]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(61), pa.int64()), "text": pa.array([t.encode() for t in texts], pa.binary()), "held": pa.array(held)})
    train = [t.lower().split() for t, x in zip(texts, held, strict=True) if not x]
    n = collections.Counter(w for t in train for w in t)
    hash_of = lambda w: int(shingling.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
    (counted,) = brown_lm._counted([batch.filter(pa.array([not x for x in held]))], 1)
    v = np.frombuffer(counted.column("payload")[0].as_py(), brown_lm._VOCAB)
    assert dict(zip(v["h"].tolist(), v["n"].tolist(), strict=True)) == {hash_of(w): k for w, k in n.items()}
    frequent = [w for w, _ in sorted(n.items(), key=lambda x: (-x[1], hash_of(x[0])))][:8]
    h = np.array([hash_of(w) for w in frequent], np.uint64)
    order = np.argsort(h)
    encoded = list(brown_lm._encoded([batch], (h[order], order)))
    classes = np.array([*(k % 3 for k in range(12)), 3])
    spelt = lambda w: int(brown_lm.spelling(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0])
    item = lambda w: 12 if w is None else frequent.index(w) if w in frequent else 8 + spelt(w)
    ended = [[None, *t, None] for t in train]
    pair0 = np.zeros((4, 4))
    contexts = collections.defaultdict(collections.Counter)
    for t in ended:
        for a, b in zip(t, t[1:], strict=False):
            if b is None or b in frequent:
                pair0[classes[item(a)], classes[item(b)]] += 1
            else:
                contexts[b][classes[item(a)]] += 1
    xlogx = lambda x: x * math.log(x) if x > 0 else 0.0
    size = pair0.sum(axis=0)
    own = {}
    for w, c in contexts.items():
        gain = [sum(xlogx(pair0[x, k] + m) - xlogx(pair0[x, k]) for x, m in c.items()) - xlogx(size[k] + n[w]) + xlogx(size[k]) for k in range(3)]
        own[w] = int(np.argmax(gain))
    class_of = lambda w: 3 if w is None else own[w] if w in own else int(classes[item(w)])
    pair = np.zeros((4, 4))
    for t in ended:
        for a, b in zip(t, t[1:], strict=False):
            pair[classes[item(a)], class_of(b)] += 1
    share = (pair.sum(axis=0) + 1) / (pair.sum() + 4)
    move = (pair + brown_lm.ALPHA * share) / (pair.sum(axis=1, keepdims=True) + brown_lm.ALPHA)
    members = collections.defaultdict(list)
    for w in n:
        members[class_of(w)].append(w)
    below = {c: sum(n[w] + brown_lm.DELTA for w in ws) + brown_lm.DELTA for c, ws in members.items()}
    p = lambda a, b: move[classes[item(a)], class_of(b)] * (1 if b is None else (n[b] + brown_lm.DELTA) / below[class_of(b)])
    for a in [None, *frequent, words[30]]:  # words, an unknown one for each class, and the end
        assert math.isclose(sum(p(a, w) for w in n) + sum(move[classes[item(a)], c] * brown_lm.DELTA / below[c] for c in range(3)) + p(a, None), 1, rel_tol=1e-9)
    count = np.zeros(13, np.int64)
    count[:8], count[12] = [n[w] for w in frequent], len(train)
    clusters = brown_lm.Clusters(classes, count, pair0, sum(n.values()) + len(train), len(n) + 1)
    full = np.empty(len(v), brown_lm._WORDS)
    full["h"], full["n"] = v["h"], v["n"]
    asked = [x for b in brown_lm._asked(encoded, classes, 1) for x in b.column("payload").to_pylist()]
    got = list(brown_lm._met([pa.RecordBatch.from_pydict({"kind": pa.array([0] + [1] * len(asked)), "payload": pa.array([full.tobytes(), *asked], pa.binary())})], pair0, 1))
    sums = [np.frombuffer(got[0].column(c)[0].as_py(), k) for c, k in (("pair", "<f8"), ("tokens", "<i8"), ("kinds", "<i8"))]
    model = brown_lm.fitted(clusters, sums[0].reshape(4, 4), sums[1], sums[2])
    assert np.allclose(10**model.transition, move)
    score = collections.Counter()
    for b in brown_lm._scored(encoded, model):
        score.update(dict(zip(b.column("row").to_pylist(), b.column("score").to_pylist(), strict=True)))
    for b in brown_lm._summed_rows(got[1:], model):
        score.update(dict(zip(b.column("row").to_pylist(), b.column("more_score").to_pylist(), strict=True)))
    for k, t in enumerate(texts):
        t = [None, *t.lower().split(), None]
        assert math.isclose(score[k], sum(math.log10(p(a, b)) for a, b in zip(t, t[1:], strict=False)), rel_tol=1e-9), t


def test_chat(spark):
    turn = lambda c, k, t, role="user": (c, k, role, t, "extra")
    rows = [turn(1, 0, "a"), turn(1, 1, "b"), turn(2, 0, "a"), turn(3, 0, "a"), turn(3, 1, "b"), turn(4, 0, "a"), turn(4, 1, "c"), turn(5, 0, None), turn(None, 0, "z"), turn(4, 1, "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat_format.rendered(df).collect()}
    assert set(got) == {1, 4, 5, None} and got[1][:2] == (2, 2)
    assert got[4][2] == "<|user|>\na\n<|user|>\nc\n<|end|>"
    assert chat_format.rendered(df.limit(0)).count() == 0


def test_secrets(docs, none):
    got = {r.doc_id: r for r in secret_scan.found(docs).collect()}
    assert [b["kind"] for b in got[14].base] == ["assign", "access", "hex"]
    assert all(not got[i].base for i in got if i != 14)
    a = got[14].base[0]
    assert TEXTS[14][a["start"] : a["end"]] == "password=abc123def" and a["value"] == "abc123def"
    assert secret_scan.found(none).count() == 0


def test_secret_models(spark):
    secret = "k9ZqX2vB7LmT4wPj8RsYc3"
    words = "configuration setting name application directory password container register parameter value listener module".split()
    rows = [(i, f"note secret={hashlib.sha256(str(i).encode()).hexdigest()[:30]} {words[i % 12]}_{words[i // 12]}-{words[i * 7 % 12]} {words[i * 5 % 12]}{words[i // 5]}") for i in range(60)]
    rows.append((99, f"see {secret} or application_configuration-File_name here"))
    got = {r.doc_id: r.extra for r in secret_scan.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x["value"] for x in got[99]] == [secret]


def shingle_set(t):
    w = W.findall(low(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets, ids):
    label = dict(enumerate(ids))
    for _ in sets:
        for i, s in enumerate(sets):
            for j, t in enumerate(sets):
                if s and t and 100 * len(s & t) >= 80 * len(s | t):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_jaccard(docs, none):
    rows = [r for r in docs.collect() if r.doc_id is not None]
    sets = [shingle_set(r.text) for r in rows]
    want = components(sets, [r.doc_id for r in rows])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.linked(docs).collect() if r.doc_id is not None]
    assert sorted(got) == sorted((r.doc_id, len(s), want[i]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    assert jaccard_join.linked(none).count() == 0


def test_jaccard_large_buckets(spark):
    """A near-copy group over the bucket limit, whose members link through few others."""
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(40):
        w = list(base)
        for j in range(k % 5):
            w[(k * 13 + j * 29) % 120] = f"c{k}x{j}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components([shingle_set(t) for t in texts], range(40))
    assert {r.doc_id: r.component_id for r in jaccard_join.linked(df).collect()} == want


def test_jaccard_bucket_of_thousands(spark):
    """Near copies that share their rarest shingles, in groups that link within and hardly across, against brute force."""
    base = [f"b{i}" for i in range(60)]
    texts = []
    for k in range(2500):
        w = list(base)
        if k % 3:  # three families: 0, 9 and 18 words of the base replaced
            for j in range(0, 9 * (k % 3)):
                w[j] = f"f{k % 3}x{j}"
        w[30 + k % 29] = f"v{k % 97}"
        w.extend(f"t{k % 11}x{j}" for j in range(k % 7))
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    number = {}
    one = np.zeros((len(texts), len({g for x in sets for g in x})), np.float32)
    for i, x in enumerate(sets):
        one[i, [number.setdefault(g, len(number)) for g in x]] = 1
    both, n = one @ one.T, one.sum(axis=1)
    links = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    least = np.arange(len(texts))
    while True:
        new = np.where(links, least[None, :], len(texts)).min(axis=1)
        new = np.minimum(least, new[new])
        if (new == least).all():
            break
        least = new
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in jaccard_join.linked(df).collect()} == dict(enumerate(least.tolist()))
    assert 1 < len(set(least.tolist())) < 200


def test_word_hashes_of_any_piece(monkeypatch):
    """Words cut by pieces, very long words and texts without words, against split()."""
    rnd, seen, texts_of = np.random.default_rng(3), {}, {}
    for piece in (5, 16, 64, 1 << 19):
        monkeypatch.setattr(shingling, "PIECE", piece)
        texts = [bytes(rnd.choice(list(b"abAB  \n\t\xc3z"), size=n)) for n in (0, 1, 9, 40, 200, 3)] + [b"x" * 300, b"", b" " * 70, b"y" * 64 + b" z"]
        for most in (1, 50, 1 << 20):
            at = []
            for a, b, data, offsets in shingling.slices(pa.array(texts, pa.binary()), most):
                h, counts = shingling.words(data, offsets)
                at += [x.tolist() for x in np.split(h, np.cumsum(counts)[:-1])]
            assert [len(x) for x in at] == [len(t.split()) for t in texts]
            for t, x in zip(texts, at, strict=True):
                for w, v in zip(t.lower().split(), x, strict=True):
                    assert seen.setdefault(w, v) == v and texts_of.setdefault(v, w) == w


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([("q1", sentence(9, 45)), ("q2", "one two"), ("q3", None), (None, "nothing here"), ("q1", sentence(9, 45))], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.verdicts(docs, bench).collect()}
    assert got[0].n_words == 0 and not got[0].contaminated
    assert (got[3].n_hit, got[3].n_items, got[3].items_sha256) == (2, 1, hashlib.sha256(b"q2").hexdigest())
    assert got[11].n_hit == 45 and got[11].contaminated and got[8].n_hit == 0
    blocks = {r.doc_id: tuple(r) for r in decontaminate.verdicts(docs.where("doc_id <> 5"), bench, block_bytes=50).collect()}
    assert all(blocks[i] == tuple(got[i]) for i in blocks)
    kept = {r.doc_id: r.text for r in decontaminate.cleaned(docs, bench).collect()}
    assert 11 not in kept and kept[8] == TEXTS[8] and kept[0] is None
    assert decontaminate.verdicts(none, bench).count() == 0 and decontaminate.verdicts(docs, bench.limit(0)).count() == docs.count()


def _two_block_case(spark):
    """Rows that repeat a doc_id or have none, and passages whose hits of several items overlap or touch."""
    bench = spark.createDataFrame([(f"q{k}", sentence(9 + k, 45)) for k in range(6)] + [("p", " ".join(sentence(9, 45).split()[20:]) + " more words here")], "item_id string, text string")
    joined = sentence(20, 2000) + " " + sentence(9, 45) + " " + sentence(10, 45) + ", tail"
    rows = [(5, sentence(9, 45)), (5, sentence(40, 90)), (5, sentence(40, 90)), (None, sentence(10, 45)), (None, "é " + sentence(41, 80)), (None, None), (7, joined), (8, sentence(20, 3000) + " é " + sentence(9, 45) + " more words here"), (9, "")]
    docs = spark.createDataFrame([(i, t, "x", 0 if t is None else len(t)) for i, t in rows], "doc_id long, text string, _row string, n_chars long")
    return docs, bench


def test_decontamination_blocks_keep_rows(spark):
    docs, bench = _two_block_case(spark)
    key = lambda df: sorted(map(repr, df.collect()))
    one = key(decontaminate.scan(docs, bench))
    assert len(one) == docs.count() and any("hit_words=[2000" in r for r in one)
    for size in (500, 1000):
        assert key(decontaminate.scan(docs, bench, block_bytes=size)) == one
        assert key(decontaminate.verdicts(docs, bench, block_bytes=size)) == key(decontaminate.verdicts(docs, bench))


def test_cleaned_in_blocks(spark):
    """Benchmark text of several blocks: the same rows as with one block, not an error."""
    docs, bench = _two_block_case(spark)
    key = lambda df: sorted(map(repr, df.collect()))
    one = decontaminate.cleaned(docs, bench)
    got = decontaminate.cleaned(docs, bench, block_bytes=500)
    assert got.columns == docs.columns and key(got) == key(one) and 0 < len(key(one)) < docs.count()


def test_html():
    field = html_extract.trained(html_extract.labelled_pages())
    held = html_extract.labelled_pages(150, seed=991)
    pairs = [(a, b) for h, y in held for a, b in zip(field.decode(html_extract.features(html_extract.blocks(h))), y, strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.98
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three.<p>Last <b>bold text.</article><div id=comments><p>First!</p></div><footer>&copy; x</footer>"
    assert html_extract.main_text(page, field) == "A & B\n\nOne two three.\n\nLast bold text."
    for odd in ("", "<", "<p", "<!-- x", "<p class='x>y", "plain", "</p></p>", "<script>x"):
        assert isinstance(html_extract.main_text(odd, field), str)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, "u", "clash"), (2, "", None, "clash"), (2, "<article><p>Text of it.</p></article>", "u", "c")], "page_id long, html string, url string, text string")
    got = html_extract.extracted(df, "page_id", "url").collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 11]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.verdicts(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        t = next(d for d in docs.collect() if d.doc_id == r.doc_id).text or ""
        w = W.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = [0] * len(w)
        for j in range(len(w) - 2):
            if c[(w[j], w[j + 1], w[j + 2])] > 1:
                hit[j : j + 3] = [1] * 3
        seen, dup = set(), 0
        for x in t.split("\n"):
            if W.search(x):
                dup += x in seen
                seen.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, sum(hit)), r.doc_id
        assert r.kept == (not r.base_failed)  # too few labels for any cutoff
    assert quality.verdicts(none, labels).count() == 0


def test_cutoff_rejects(spark):
    """Bad documents by label are full of signs: a cutoff takes them, and unlabelled ones like them, and leaves clean ones."""
    rows = [(i, sentence(i, 60) + ("".join(f" #{j}$%{j}&" for j in range(60)) if i % 4 == 0 else ""), "en") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    got = quality.verdicts(docs, labels).collect()
    assert {r.doc_id for r in got if not r.kept and not r.base_failed} == {i for i in range(1600) if i % 4 == 0}


def test_cutoffs_hold_their_risk(spark):
    from pyspark.sql import functions as F

    rows = [(i, "en", 100, 500, 90 if i % 10 == 0 else i % 3, 0, 0, int(i % 10 != 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality int")
    got = quality.cutoffs(df.drop("quality"), df.select("doc_id", "quality")).collect()
    assert [(r.stratum, r.score) for r in got] == [("en", "symbol_share")] and 0.02 <= got[0].cutoff < 0.9
    # labels or rows that repeat are no further trials
    few = df.where("doc_id < 60")
    once = quality.cutoffs(few.drop("quality"), few.select("doc_id", "quality")).collect()
    again = few.drop("quality").union(few.drop("quality")), few.select("doc_id", "quality").crossJoin(spark.range(32)).drop("id")
    assert once == [] and quality.cutoffs(*again).collect() == once
    tail = spark.range(1).select(quality.binomial_tail(F.lit(3).cast("long"), F.lit(100).cast("long"), 0.05)).first()[0]
    assert math.isclose(tail, sum(math.comb(100, i) * 0.05**i * 0.95 ** (100 - i) for i in range(4)), rel_tol=1e-9)


def test_secret_models_measured(spark):
    """Random strings that no rule names are caught, secrets don't train the ordinary model, identifiers stay."""
    import base64

    made = [base64.b64encode(hashlib.sha256(f"other {k}".encode()).digest()).decode()[: 20 + k % 20].rstrip("=") for k in range(300)]
    plain = ["getUserAccountSettingsById", "MAX_CONNECTION_POOL_SIZE", "com-example-application-server2", "internationalizationHelper", "/usr/share/documentation/index2"]
    rows = [(k, f"see {x} and {sentence(k, 30)} handlers processing") for k, x in enumerate(made)]
    rows += [(1000 + k, f"call {x} for something ordinary like configuration_parser or environment") for k, x in enumerate(plain * 4)]
    syllables = "con ver ta tion in ter na pro cess ing de ment or able re port er al ly un der stand ex press ive com pu ter get set user name list count max min".split()
    r = np.random.default_rng(5)
    rows += [(3000 + k, " ".join(r.choice(["", "_", "-"]).join(r.choice(syllables, size=r.integers(3, 6))) for _ in range(40))) for k in range(200)]
    rows += [(2000, "password=QwErTyUiOpAsDfGh and token: zXcVbNmLkJhGfDsA plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not {w for r in secret_scan.scanned(docs).where("doc_id = 2000").collect() for w in r.ordinary} & {"QwErTyUiOpAsDfGh", "zXcVbNmLkJhGfDsA"}
    got = {r.doc_id: r for r in secret_scan.found(docs).collect()}
    assert sum(bool(got[k].extra) for k in range(300)) >= 285
    assert sum(bool(got[1000 + k].extra) for k in range(20)) == 0 and [b.value for b in got[2000].base] == ["QwErTyUiOpAsDfGh", "zXcVbNmLkJhGfDsA"]


def test_long_conversation(spark):
    """Snapshots of a long conversation, with repeated rows and a null turn, are prefixes of it."""
    turns = [(None if k == 0 else k, "user" if k % 2 else "bot", f"t{k % 50}") for k in range(3000)]
    rows = [(1, *t) for t in turns] + [(2, *t) for t in turns[:2999]] + [(3, *t) for t in turns[:1500] * 2] + [(4, *turns[0]), (5, 0, "bot", "t0"), (None, *turns[0]), (None, *turns[1])]
    got = {r.conv_id: r for r in chat_format.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert set(got) == {1} and got[1].n_turns == 3000 and got[1].text == "".join(f"<|{r}|>\n{x}\n" for _, r, x in turns) + "<|end|>"


def test_pages_written_by_hand():
    """Pages that no generator wrote."""
    field = html_extract.trained(html_extract.labelled_pages())
    for page, want in HAND_PAGES:
        assert html_extract.main_text(page, field).split("\n\n") == want


HAND_PAGES = [
    (
        """<html><head><title>Bread</title><script>if (1<2) {}</script></head><body><div id="top-nav"><a href="/">Home</a> <a href="/b">Blog</a></div>
<div class="cookie-banner">We use cookies to improve your visit. <button>OK</button></div>
<main><h1>Baking bread at home</h1><p>Bread needs flour, water, salt and time. The dough &mdash; once mixed &mdash; rests for an hour.</p>
<div class="ad-slot"><p>Buy our new oven today!</p></div><p>Formula: <math><mi>w</mi><mo>=</mo><mn>0.7</mn></math> of the flour.</p>
<ul><li>500 g of flour</li><li>350 g of water</li></ul></main>
<div class="comments"><h3>Comments</h3><p>Great recipe, thanks!</p></div><footer>&copy; 2020 Bakers. All rights reserved.</footer></body></html>""",
        ["Baking bread at home", "Bread needs flour, water, salt and time. The dough — once mixed — rests for an hour.", "Formula: w=0.7 of the flour.", "500 g of flour", "350 g of water"],
    ),
    (
        """<body><header><h2>City News</h2></header><nav><ul><li><a href=/s>Sport</a><li><a href=/p>Politics</a></ul></nav>
<article class=post><h1>Bridge opens after repairs</h1><p>The old bridge was opened again on Monday after two years of work.
<p>Engineers said that the <b>new cables</b> will last for decades.<blockquote>It was worth the wait, said the mayor.</blockquote></article>
<aside><h3>Related</h3><ul><li><a href=/1>Road closed</a><li><a href=/2>Tunnel planned</a></ul></aside><form action=/s><input name=q><button>Search</button></form>""",
        ["Bridge opens after repairs", "The old bridge was opened again on Monday after two years of work.", "Engineers said that the new cables will last for decades.", "It was worth the wait, said the mayor."],
    ),
    (
        """<div><div><p>A plain page has no names at all, but its paragraphs are long enough to be told apart from what surrounds them.</p>
<p>The second paragraph goes on with the story, and it ends with a full stop.</p></div><div>Sign up now for offers.</div></div>""",
        ["A plain page has no names at all, but its paragraphs are long enough to be told apart from what surrounds them.", "The second paragraph goes on with the story, and it ends with a full stop."],
    ),
]


def test_pages_are_read_in_linear_time():
    import time

    for x in ("<a " * 40_000, "<head>" * 4_000, '<a ">"' * 20_000, "<script " * 9_000, "<!-" * 40_000, "&" * 100_000):
        began = time.process_time()
        html_extract.blocks(x)
        assert time.process_time() - began < 5, x[:6]
    assert html_extract.extracted is not None
