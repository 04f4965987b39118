"""Operators that judge each text by itself."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import fixture_rows, frame, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import audio, bytebpe, license, repetition, tokencounts, tokenids

ROWS = fixture_rows()



def by_id(df):
    return Counter(tuple(r) for r in df.collect())


# op1

def test_audio(spark):
    got = by_id(audio.map_texts(frame(spark, ROWS, True), "doc_id", "text", audio.DIGESTS, audio._digests).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"))
    want = Counter()
    for i, t in ROWS:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = audio.to_wav(p)
        want[i, len(raw), len(p), sha(p), zlib.crc32(p[-16:]), len(media), sha(media)] += 1
    assert got == want


def test_wav_round_trip():
    import io
    import wave

    for n in (0, 1, 7, 192):
        samples = bytes(i * 37 % 256 for i in range(n))
        assert audio.from_wav(audio.to_wav(samples)) == (samples, audio.RATE)
        with wave.open(io.BytesIO(audio.to_wav(samples))) as w:
            assert w.readframes(n) == samples and w.getsampwidth() == 1
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFFxxxxWAVEdata")


def test_resample_and_mel_by_hand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500).astype(np.float32)
    n = 2 * audio.TAPS * audio.UP + 1
    t = (np.arange(n) - n // 2) / audio.UP
    cut = min(1, audio.UP / audio.DOWN)
    h = np.sinc(t * cut) * cut * np.hamming(n)
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    full = np.convolve(up, h)[n // 2 :][:: audio.DOWN]
    y = audio.resample(x)
    assert len(y) == -(-len(x) * audio.UP // audio.DOWN) and np.allclose(y, full[: len(y)], atol=1e-4)
    mel = audio.log_mel(y)
    padded = np.zeros((len(mel) - 1) * audio.HOP + audio.WINDOW)
    padded[: len(y)] = y
    _, hann, bank = audio._filters()
    for k in range(len(mel)):
        power = np.abs(np.fft.rfft(padded[k * audio.HOP : k * audio.HOP + audio.WINDOW] * hann)) ** 2
        assert np.allclose(mel[k], 10 * np.log10(power @ bank + audio.FLOOR), atol=1e-2)


def test_segments():
    level = np.array([0, 1, 2, 4, 2, 0, 2, 2, 0, 5.0])
    assert audio.segments(level, 3, 1.5) == [(2, 5), (9, 10)]
    assert audio.segments(np.zeros(0), 1, 0) == []


def test_tensors(spark):
    """The stored tensors have a fixed shape and their time spans, and come back as they were."""
    df = audio.to_media(frame(spark, ROWS))
    media = {r.doc_id: bytes(r.media) for r in df.collect()}
    files = audio.feature_files(df).collect()
    assert len(files) == len(ROWS)
    for r in files:
        f = audio.Features(media[r.doc_id])
        table = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        assert table.schema.field("log_mel").type == audio.tensor_type()
        spans, tensors = audio.from_tensors(bytes(r.tensors))
        want = list(f.blocks())
        assert tensors.shape == (len(want), audio.BLOCK, audio.MELS)
        assert spans.tolist() == [[a, b] for a, b, _ in want] and (spans[1:, 0] == spans[:-1, 1]).all()
        assert np.allclose(np.concatenate(tensors)[: len(f.mel)], f.mel, atol=1e-2)  # another process may add in another order
        again, same = audio.from_tensors(audio.to_tensors(f))
        assert (again == spans).all() and (np.concatenate(same)[: len(f.mel)] == f.mel).all()
    assert audio.feature_blocks(df).count() == sum(len(audio.from_tensors(bytes(r.tensors))[0]) for r in files)
    assert audio.active_spans(df).where("end_s <= begin_s").count() == 0


# op2

def brute_repetition(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def brute_coverage(t, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, hit = set(), set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            hit |= set(range(i, i + n))
        seen.add(g)
    return sum(len(words[i]) for i in hit)


def brute_top(t, n):
    """Characters of the most frequent n-gram; of equally frequent ones, the most."""
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    count = Counter(grams)
    most = max(count.values(), default=0)
    if most < 2:
        return 0
    inside = lambda g: {i + k for i, x in enumerate(grams) if x == g for k in range(n)}
    return max(sum(len(words[i]) for i in inside(g)) for g, c in count.items() if c == most)


def brute_kept(t):
    lines = Counter(line for line in (t or "").split("\n"))
    later = sum((c - 1) * sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line))) for line, c in lines.items())
    _, total, *_, failed = brute_repetition(t)
    dup = [brute_coverage(t, n) > share * total for n, share in repetition.DUPLICATED.items()]
    top = [brute_top(t, n) > share * total for n, share in repetition.TOP.items()]
    return not (failed or any(dup) or any(top) or later > repetition.LINES * total), later


def test_repetition(spark):
    got = by_id(repetition.measure(frame(spark, ROWS, True)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == Counter((i, *brute_repetition(t)) for i, t in ROWS)
    for _, t in ROWS:
        m = repetition.measures(t or "")
        assert m[8] == [brute_coverage(t, n) for n in repetition.DUPLICATED]
        if len(t or "") < 50_000:
            assert m[9] == [brute_top(t, n) for n in repetition.TOP] and (m[6], m[7]) == brute_kept(t)
    kept = repetition.keep(frame(spark, ROWS, True))
    assert kept.columns == frame(spark, ROWS, True).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in ROWS if repetition.measures(t or "")[6])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "\n", " ", "a\n", "|", "cc"]), max_size=60))
def test_repetition_random(parts):
    t = " ".join(parts)
    assert repetition.measures(t)[:6] == brute_repetition(t)
    m = repetition.measures(t)
    assert m[8] == [brute_coverage(t, n) for n in repetition.DUPLICATED] and m[9] == [brute_top(t, n) for n in repetition.TOP]
    assert (m[6], m[7]) == brute_kept(t)


def test_repetition_ties():
    """Of equally frequent n-grams the one with the most characters counts, whatever the letters are."""
    for pair in ("aa bb", "cc dd", "zz q1", "é1 é2"):
        text = " ".join(f"{pair} s{i} {'long' * 8} {'other' * 8} t{i}" for i in range(20))
        m = repetition.measures(text)
        assert m[9] == [brute_top(text, n) for n in repetition.TOP] and (m[6], m[7]) == brute_kept(text)
    tied = [repetition.measures(" ".join(f"x{i}" for i in range(60)) + f" {a} y {'w' * 90} {'v' * 90} z {a} u {'w' * 90} {'v' * 90}") for a in ("aa bb", "cc dd", "zz qq")]
    assert len({(m[6], tuple(m[9])) for m in tied}) == 1 and tied[0][9][0] == 360


# op3

def reference_coder():
    return bytebpe.coder().encoding


def test_bpe(spark):
    got = by_id(bytebpe.encode_documents(frame(spark, ROWS, True), finish=bytebpe.digests, fields=bytebpe.DIGESTS))
    want = Counter()
    for i, t in ROWS:
        ids = reference_coder().encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert got == want
    ids = bytebpe.encode_documents(frame(spark, ROWS))
    back = bytebpe.decode_ids(ids)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in ROWS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "Ünï", "'s", " ", "  ", "\n", "\t", " ", "　", "12", "!?", "\x1c", "\x85"]), max_size=40), st.sampled_from([" ", "\n", "\t", " "]))
def test_bpe_pieces(parts, space):
    own = bytebpe.coder()
    unit = "".join(parts)
    for text in (unit * 900, unit + space * 3000 + unit, space * 1500, unit + space * 1030 + " x"):
        assert own.encode(text) == own.encoding.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


# op4

def brute_count(pieces, word):
    token = tokencounts.BEGIN + word
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        options = []
        for begin in range(end):
            s = pieces.score.get(token[begin:end])
            if s is not None:
                options.append((best[begin][0] + s, -(best[begin][1] + 1)))
        if token[end - 1] not in pieces.score:
            options.append((best[end - 1][0] + pieces.unknown, -(best[end - 1][1] + len(token[end - 1].encode()))))
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(spark):
    own = tokencounts.pieces()
    got = by_id(tokencounts.count_tokens(frame(spark, ROWS, True)))
    known, want = {}, Counter()
    for i, t in ROWS:
        words = (t or "").encode().split()
        for w in words:
            if w not in known:
                known[w] = brute_count(own, w.decode())
        n = [known[w] for w in words]
        want[i, len(n), sum(n), max(n, default=0)] += 1
    assert got == want


def test_pieces_are_probabilities():
    own = tokencounts.pieces()
    assert sum(np.exp(list(own.score.values()))) == pytest.approx(1) and not [p for p in own.score if p != tokencounts.BEGIN and not p.strip(tokencounts.BEGIN)]


def test_trie_shares_prefixes(monkeypatch):
    """A node for each distinct prefix, whatever the order of words; a full trie begins anew with the same counts."""
    words = "in inner inn inside outside out 日本語 日本 naïve naïvely".split() + ["x" * 300, ""]
    own, again = tokencounts.Pieces(), tokencounts.Pieces()
    own.learn({w.encode() for w in words})
    for w in reversed(words):
        assert again.count[again.insert(w)] == own.terminals[w.encode()] == brute_count(own, w)
    prefixes = {(tokencounts.BEGIN + w)[:k] for w in words for k in range(len(w) + 2)}
    assert len(own.best) == len(again.best) == len(prefixes)
    monkeypatch.setattr(tokencounts, "NODES", 5)
    small = tokencounts.Pieces()
    small.learn({w.encode() for w in words})
    assert small.terminals == own.terminals and len(small.best) < 400


# op5

def test_token_files(spark, tmp_path):
    own = tokenids.coder()
    rows = [*ROWS, (None, "no id")]
    files = tokenids.token_files(frame(spark, rows, True), f"{tmp_path}/f", parts=3)
    got = {(r.doc_id, r.start): list(r.ids) for r in tokenids.read_ids(files).collect()}
    at, want = 0, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, at] = ids
        at += len(ids)
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_word_coder(t):
    own = tokenids.coder()
    for text in (t, t + "<|endoftext|>." + t.upper()):
        got = np.frombuffer(own.encode_many([text])[0], "<u4").tolist()
        assert got == own.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=30), st.integers(1, 120))
def test_repair(unit, times):
    ids = np.array(unit * times, np.uint32)
    shard = tokenids.Shard(tokenids.pack(ids))
    assert (shard.ids() == ids).all() and len(shard.ids()) == len(ids)
    for a, b in ((0, 1), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids) + 5)):
        assert (shard.ids(max(0, a), b) == ids[max(0, a) : b]).all()


def test_repair_compresses():
    ids = np.array([1, 2, 3, 4] * 5000, np.uint32)
    packed = tokenids.pack(ids)
    assert len(packed["symbols"]) < 2 * len(ids) / 3


def brute_repair(ids, least):
    """Round after round over all of the sequence: (symbols, rules)."""
    s, base, rules = list(ids), max(ids, default=-1) + 1, []
    while True:
        often = sorted(p for p, n in Counter(zip(s, s[1:])).items() if n >= least)
        if not often:
            return s, rules
        number = {p: base + len(rules) + k for k, p in enumerate(often)}
        rules, out, k = rules + often, [], 0
        while k < len(s):
            new = number.get(tuple(s[k : k + 2]))
            out.append(s[k] if new is None else new)
            k += 1 if new is None else 2
        s = out


# The check's CPU seconds of op5: a round after the first only looks at pairs with new symbols, and makes the same rules.
def test_repair_rounds_look_at_new_symbols(monkeypatch):
    draw, seen = np.random.default_rng(5), []
    plain = tokenids._by_pair
    monkeypatch.setattr(tokenids, "_by_pair", lambda pair: seen.append(len(pair)) or plain(pair))
    for most, times in ((2, 1), (40, 1), (40, 9), (70_000, 9)):
        ids = np.tile(draw.zipf(1.4, 900) % most, times).astype(np.uint32)
        s, rules, base = tokenids.compress(ids, 8)
        assert (s.tolist(), list(map(tuple, rules.tolist()))) == brute_repair(ids.tolist(), 8) and base == ids.max() + 1
    ids = np.r_[np.arange(100, 60_000), np.tile(np.arange(16), 8)].astype(np.uint32)
    seen.clear()
    tokenids.compress(ids, 8)
    assert len(seen) == 5 and sum(seen[1:]) < 300


# The check's CPU seconds of op5: a word is looked up once for all its places.
def test_texts_encoded_by_column():
    own = tokenids.WordCoder()
    texts = ["one two", None, "", " two\x0btwo ONE\x1cx <|endoftext|> ", "naïve, NAÏVE. 日本。", "<| One\n"] * 40
    ids, upto = own.encode_column(pa.array(texts, pa.large_string()))
    got = [ids[a:b].tolist() for a, b in zip(upto, upto[1:])]
    assert got == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts] and len(ids) == upto[-1]
    assert len(own.cache) < 20


# op7

def license_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_base(t):
    """Places of all phrases, by comparing each window."""
    words = license_words(t)
    base, labels = [], set()
    for k, (phrase, label) in enumerate([*license.BASE, *license.MORE]):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                labels.add(label)
                if k < len(license.BASE):
                    base.append((i, label))
    return (len(words), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None), ",".join(sorted({b for _, b in base}))), labels


def brute_license(rows):
    """(labels, score) of each row: every start of every template is tried."""
    docs = [license_words(t) for _, t in rows]
    df, out = Counter(w for d in docs for w in set(d)), []
    for words in docs:
        labels, score, have = set(), 0.0, set(words)
        for t in license.templates():
            n, first = len(t.words), min(df[w] for w in t.words)
            ranked = sorted(set(t.words), key=lambda w: (df[w], t.words.index(w)))[: license.KEYS]
            keys = [w for w in ranked if w == ranked[0] or (len(docs) + 1) * (first + 1) >= (df[w] + 1) ** 2]
            looked = [k for k in keys if k in have][: license.LOOKED]
            for start in range(1 - n, len(words)):
                at = [(words[start + j] if 0 <= start + j < len(words) else None) for j in range(n)]
                if len({k for k in looked if any(x == y == k for x, y in zip(at, t.words))}) < min(license.AGREE, len(keys)):
                    continue
                same = [x == y for x, y in zip(at, t.words)]
                share = sum(same) / n if all(all(same[i : i + m]) for i, m in t.must) else 0.0
                score = max(score, share)
                if share >= t.covered:
                    labels.add(t.label)
        out.append((",".join(sorted(labels)), score))
    return out


MIT, BSD = license.PASSAGES[0][0], license.PASSAGES[1][0]
LICENSES = [
    (1, "CC BY cc-by CC  BY-SA 4.0"), (2, "GNU Lesser General Public License"), (3, "by cc by"), (4, "cc"), (5, None), (6, ""), (7, "all rights reserved All Rights Reserved"),
    (8, "K cc by İ LİCENSE general public licenſe"), (9, "Permission is hereby granted, free of charge"), (10, "so permission is hereby granted to none"), (11, "...cc...by..."), (12, "general public license " * 500), (12, "general public license " * 500),
    (13, MIT.upper()), (14, "x " * 9 + MIT.replace("sublicense", "resell").replace("merge", "mix")), (15, MIT.replace("free of charge", "for a fee")), (16, " ".join(MIT.split()[7:])), (17, " ".join(BSD.split()[:-8])),
    (18, " ".join(w for pair in zip(MIT.split(), BSD.split()) for w in pair)), (19, MIT + " " + BSD), (20, BSD + " and " + BSD.replace("source", "sauce")), (21, " ".join(reversed(MIT.split()))),
]


def test_license(spark):
    rows = [*((i, t) for i, t in ROWS if len(t or "") < 20_000), *((500 + i, t) for i, t in LICENSES)]
    out = license.scan(frame(spark, rows, True))
    assert by_id(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == Counter((i, *brute_base(t)[0]) for i, t in rows)
    got = by_id(out.selectExpr("doc_id", "labels", "round(score, 9)"))
    assert got == Counter((i, labels, round(score, 9)) for (i, _), (labels, score) in zip(rows, brute_license(rows)))
    labels = {r.doc_id: set(r.labels.split(",")) for r in out.collect()}
    for i, t in rows:
        assert brute_base(t)[1] <= labels[i]  # no phrase is missed
    # Altered and shortened passages are found, those without a key phrase or out of order aren't.
    assert {i for i in labels if "mit" in labels[i]} == {509, 513, 514, 519} and {i for i in labels if "bsd" in labels[i]} >= {517, 519, 520}


def test_license_long_text(spark):
    """One file of very many places, and one without any."""
    rows = [(1, "general public license " * 20_000), (2, "plain words " * 100_000)]
    got = {r.doc_id: (r.n_words, r.n_base, r.labels) for r in license.scan(frame(spark, rows)).collect()}
    assert got[1][:2] == (60_000, 20_000) and "gpl" in got[1][2] and got[2] == (200_000, 0, "")


# empty tables

@pytest.mark.parametrize("f", [repetition.measure, bytebpe.encode_documents, tokencounts.count_tokens, license.scan, audio.to_media, tokenids.token_files])
def test_empty(spark, f):
    assert f(frame(spark, [])).count() == 0


def test_oracle_sql_of_corpus_operators(spark):
    """Queries with SQL against DuckDB on the smallest documents."""
    import duckdb

    from waymark.llm import registry

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        got = con.execute(sql)
        assert [c[0] for c in got.description] == df.columns
        assert Counter(got.fetchall()) == by_id(df)


def test_registry_has_ten_operators():
    from waymark.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
