"""The training-data operators against brute force, exact round trips or held-out accuracy."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, label int, class string"


def frame(spark, texts, ids=None):
    """Documents with null cells and extra columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, "s", None, "x", 9, "c") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(draw, n, size=400):
    return " ".join(draw.choice(WORDS) for _ in range(n)) if size else ""


WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti", "vu", "wy") for b in
         ("bar", "con", "dal", "fer", "gul", "him", "jot", "kel", "lum", "mor", "nop", "pax", "qui", "rus", "sel")]
CORNERS = ["", None, " ", "\t\n", "a", "a b c d", "x" * 3000, "é ü ß 日本", "0", "same words here and there"]


def corpus(seed=3):
    draw = random.Random(seed)
    base = [prose(draw, draw.randint(1, 200)) for _ in range(60)]
    shared = prose(draw, 60)
    out = list(CORNERS) + base + base[:7] + [CORNERS[9]]
    for t in base[:30]:
        w = t.split()
        if len(w) > 60:
            w[draw.randrange(len(w))] = "edited"
            out.append(" ".join(w))
    out += [prose(draw, 20) + "\n" + shared + "  " + prose(draw, 31) for _ in range(6)]
    out += [("loop " * 50).strip(), " ".join(["lap", "run", "jog"] * 20)]
    return out


def test_exact_dedup(spark):
    from ledgerloom.llm.exact_dedup import exact_dedup, keep_distinct

    texts = corpus()
    ids = list(range(len(texts)))
    docs = frame(spark, texts + [texts[5], None], ids + [5, None])
    groups = {}
    for i, t in zip(ids + [5, None], texts + [texts[5], None]):
        groups.setdefault(t or "", []).append(i)
    for hasher in (None, lambda c: F.length(c) % 3):  # the second one collides all the time
        for keep, best in (("min", min), ("max", max)):
            extra = {"hasher": hasher} if hasher else {}
            got = exact_dedup(docs, keep=keep, **extra).collect()
            assert len(got) == len(ids) + 2
            for r in got:
                members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
                stays = best(m for m in members if m is not None)
                assert (r.keep_id, r.group_size, r.kept) == (stays, len(members), r.doc_id == stays)
    kept = keep_distinct(docs, keep="max")
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(groups)
    assert exact_dedup(frame(spark, [])).count() == 0 and keep_distinct(frame(spark, [])).count() == 0


def brute_components(texts, ids):
    sets = {}
    for i, t in zip(ids, texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(draw, n):
    base = prose(draw, 80).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w))] = draw.choice(WORDS).upper()
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("rounds", [0, 2])
def test_ngram_components(spark, rounds):
    from ledgerloom.llm.ngram_join import keep_one, ngram_components

    texts = corpus() + near_copies(random.Random(5), 60)
    ids = [7 * i % 1009 for i in range(len(texts))]
    docs = frame(spark, texts, ids)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs, rounds=rounds).collect()}
    want = brute_components(texts, ids)
    assert got == want
    if rounds:
        kept = keep_one(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for i in ids if want[i][1] == i}
        assert ngram_components(frame(spark, [])).count() == 0
        odd = ngram_components(frame(spark, ["a b", "a b", None], [None, 4, None])).collect()
        assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in odd) == [
            (-1, 0, -1), (-1, 1, 4), (4, 1, 4)]


def brute_repeats(texts, size):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - size + 1) if count[tuple(w[i:i + size])] > 1 for p in range(i, i + size)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_substring_dedup(spark):
    from ledgerloom.llm.substring_dedup import substring_dedup

    texts = corpus() + [None]
    docs = frame(spark, texts, [*range(len(texts) - 1), None])
    got = substring_dedup(docs, with_text=True).collect()
    have = Counter((r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got)
    want = brute_repeats(texts, 35)
    assert have == Counter(want) and sum(w[1] for w in want) > 300
    assert {r.doc_id: r.n_removed for r in got if r.doc_id is not None} == {i: w[1] for i, w in enumerate(want[:-1])}
    short = substring_dedup(docs, size=9, period=7, cover=(0, 1, 3)).collect()
    assert Counter((r.n_words, r.n_removed) for r in short) == Counter((w[0], w[1]) for w in brute_repeats(texts, 9))
    assert substring_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(docs, cover=(0, 1))


def test_packing_search():
    from ledgerloom.llm import packing

    draw = np.random.default_rng(2)
    for capacity in (10, 30, 1024):
        for _ in range(4):
            counts = np.zeros(capacity + 1, np.int64)
            np.add.at(counts, draw.integers(1, capacity + 1, 300), 1)
            used, fewest = np.zeros_like(counts), packing.lower_bound(counts, capacity)
            plan = packing.complete(counts, capacity)
            for content, times in plan:
                assert sum(content) <= capacity
                np.add.at(used, list(content), times)
            assert (used == counts).all()
            number = sum(n for _, n in plan)
            assert fewest <= number <= sum(n for _, n in packing.best_fit(counts, capacity))
            assert number <= fewest * 1.03 + 1
    assert packing.complete(np.zeros(11, np.int64), 10) == []
    # Best fit needs three bins for 6 4 | 5 3 2 by the wrong choice; completion finds two.
    counts = np.bincount([5, 4, 4, 3, 2, 2], minlength=11)
    assert sum(n for _, n in packing.complete(counts, 10)) == 2


def test_packing(spark):
    from tokenizers import Tokenizer

    from ledgerloom.llm.common import vocabulary_file
    from ledgerloom.llm.packing import pack

    texts = corpus() + [None, prose(random.Random(9), 900)]
    docs = frame(spark, texts, [*range(len(texts) - 2), None, 4])
    place = vocabulary_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(place)
    got = pack(docs, place, capacity=64).collect()
    want = Counter()
    for i, t in zip([*range(len(texts) - 2), None, 4], texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        head = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in got) // 64) * 1.05 + 1
    assert pack(frame(spark, []), place).count() == 0


def test_bpe(spark):
    import public_tokenizers
    import tiktoken

    from ledgerloom.llm.bpe import bpe_round_trip, coder_of
    from ledgerloom.llm.common import vocabulary_file

    place = vocabulary_file("byte_bpe_multi_50k.tiktoken")
    raw = open(place, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(4)
    odd = ["".join(draw.choice("ab 1\n\t  é'sx.,\x1c\x85　日Z\r\0-") for _ in range(draw.randint(0, 40))) for _ in range(300)]
    texts = corpus() + odd + ["ab" * 20_000, "word, word. word,, 's, a. ,"]
    got = bpe_round_trip(frame(spark, texts), place, public_tokenizers.PATTERN, with_ids=True).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        ids = own.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == t.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(texts)
    bpe, _ = coder_of(raw, public_tokenizers.PATTERN)
    assert bpe.encode(odd[0]) == own.encode_ordinary(odd[0])
    assert bpe_round_trip(frame(spark, []), place, public_tokenizers.PATTERN).count() == 0


def plain_pii(text):
    from ledgerloom.llm.pii import ORDER, luhn

    out = []
    for kind, pattern in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) < 256 for p in m.group().split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def test_pii(spark):
    from ledgerloom.llm import pii

    draw = random.Random(8)
    texts = CORNERS + ["".join(draw.choice("a1@.+-% ()0 29é") for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    texts += ["mail a.b@c.d.org. or 1.2.3.4.5.6.7.8, +1 (017) 555-7713 4539 5787 6362 1486", "9" * 5000, "@" * 3000 + "a@b.c"]
    texts += ["write john at mail dot example dot com now", "call (017) 555-7713 today", "it was at 12.30 on 2024-05-06"]
    got = pii.find_pii(frame(spark, texts)).collect()
    for r in got:
        base = plain_pii(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in pii.KINDS)
        spans = r.spans.split(",") if r.spans else []
        assert set(pii.joined([s]) for s in base) <= set(spans) and len(spans) == len(base) + r.n_added
    by_id = {r.doc_id: r.spans for r in got}
    n = len(texts)
    assert by_id[n - 3] == "email_like:6:38" and by_id[n - 2] == "phone_like:5:19" and by_id[n - 1] == ""
    masked = pii.mask_pii(frame(spark, [None, "to a@b.cd and (017) 555-7713."])).orderBy("doc_id").collect()
    assert [r.text for r in masked] == [None, "to <email> and <phone>."]
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_pii_field_generalises():
    from ledgerloom.llm import pii

    weights, right, wrong, missed = pii.trained(), 0, 0, 0
    for words, gold in pii.made_islands(random.Random(99), 300):
        found = set(pii.decode(words, weights))
        right += len(found & set(gold))
        wrong += len(found - set(gold))
        missed += len(set(gold) - found)
    assert right / (right + missed) > 0.9 and right / (right + wrong) > 0.9


def test_pii_every_written_form():
    """Each form of a hidden address is found and spans the whole of it."""
    from ledgerloom.llm import pii

    weights, draw = pii.trained(), random.Random(5)
    word = lambda: "".join(draw.choice("abdeghilmnorst") for _ in range(draw.randint(3, 8)))
    forms = ["W[at]W.W", "W7[at]W.W", "W(at)W(dot)W", "W{at}W{dot}W", "W [at] W [dot] W", "W (at) W.W", "W at W dot W",
             "W[at]W dot W", "W at W dot W dot W dot W dot W", "W dot W at W dot W", "W dot W dot W at W dot W dot W",
             "W at " + " dot ".join("W" * 12)]
    for form in forms:
        found = 0
        for _ in range(50):
            address = re.sub("W", lambda _: word(), form)
            text = f"{word()} {word()} {address}, {word()} {word()}"
            start = text.index(address)
            found += pii.added_spans(text, [], weights) == [(start, start + len(address), "email_like")]
        assert found >= 45, (form, found)
    text = "please write to john[at]site.com or (ann(at)mail(dot)org) now"
    assert pii.masked(text, pii.spans_of(text, weights)[1]) == "please write to <email> or (<email>) now"
    for plain in ("look at me", "we met at noon and dot notation", "x[at]y is an index", "a dot b dot c dot d"):
        assert pii.spans_of(plain, weights) == ([], [])
    long = "a dot " * 20_000 + "b"
    assert pii.added_spans(long, [], weights) == []


def test_neighbours(spark):
    from ledgerloom.llm.neighbours import neighbours

    draw = np.random.default_rng(1)
    x = draw.normal(size=(1200, 16)).astype(np.float32)
    x[300:700] = x[300]  # one vector that a third of all rows share
    rows = [(int(i), [float(v) for v in x[i]], 0) for i in range(1200)]
    rows += [rows[5], (2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] + [1.0] * 15, 0),
             (2060, [1.0] * 15 + [None], 0), (2080, [1.0], 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = neighbours(table, F.col("id") % 20 == 0, shard_rows=300).toPandas()
    y = x.astype(float)
    hits = 0
    for q in range(0, 1200, 20):
        score = np.zeros(1200)
        for d in range(16):
            score += y[q, d] * y[:, d]
        order = [i for i in np.lexsort((np.arange(1200), -score)) if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        assert [score[i] for i in mine.vec_id] == list(mine.score)
        assert list(zip(-mine.score, mine.vec_id)) == sorted(zip(-mine.score, mine.vec_id))
        hits += len(set(order) & set(mine.vec_id))
    assert hits >= 0.9 * 20 * 60 and len(got) == 20 * 60
    few = neighbours(table.where("vec_id < 4"), F.col("id") % 2 == 0).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(a, b) for a in (0, 2) for b in range(4) if a != b]
    assert neighbours(table.limit(0), F.col("id") % 20 == 0).count() == 0


def labelled_table(spark, name):
    # A fold of the smaller table holds a dozen toxic rows: too few to measure with.
    folder = "/root/testdata/sf0.01" if name == "quality" else "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("name, column, parts, held", [("quality", "quality", 5, 0), ("toxicity", "toxic", 4, 2)])
def test_classifiers(spark, name, column, parts, held):
    import importlib

    run = getattr(importlib.import_module(f"ledgerloom.llm.{name}"), name)
    docs, labels = labelled_table(spark, name)
    out = run(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % parts == held) == h for i, h in zip(out.doc_id, out.held_out))
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()
    mark = labels.toPandas().set_index("doc_id")[column]
    test = out[out.held_out & out.doc_id.isin(mark.index)]
    truth = mark[test.doc_id].to_numpy()
    good, bad = test.score[truth == 1], test.score[truth == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn(column, F.when(
        F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == held, 1 - F.col(column)).otherwise(F.col(column)))
    assert run(docs, flipped).toPandas().set_index("doc_id").score.equals(out.set_index("doc_id").score)
    odd = frame(spark, CORNERS + ["a b"], [*range(len(CORNERS)), None])
    assert run(odd, labels.limit(0)).where("score between 0 and 1 and not held_out or held_out").count() == len(CORNERS) + 1
    assert run(frame(spark, []), labels).count() == 0


def test_deobfuscation():
    from ledgerloom.llm import toxicity as tox

    draw = random.Random(3)
    words = WORDS + ["idiot", "stupid", "moron", "loser", "worthless"] * 8
    raw = ("  " + " ".join(draw.choice(words) for _ in range(20_000)) + " ").encode()
    c = tox._CLASS[np.frombuffer(raw, np.uint8)]
    counts = np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3).astype(float)
    reader = tox.Restorer(tox.trigram_costs(counts))
    for token, word in (("idi0t", "idiot"), ("$tup1d", "stupid"), ("m.o.r.o.n", "moron"), ("l0ooser", "loser"),
                        ("w0rthle$$", "worthless"), ("kabar", "kabar"), ("idiot###", "idiot"), ("", ""), ("12", "")):
        assert reader.word(token) == word
    found = reader.words("He is an i d i o t, S T U P I D! and Lócon")
    assert {"idiot", "stupid", "locon"} <= found


def test_deobfuscation_of_every_written_form():
    from ledgerloom.llm import toxicity as tox

    draw = random.Random(4)
    words = WORDS + ["idiot", "stupid", "trash", "ass", "you", "are", "a", "letter"] * 8
    raw = ("  " + " ".join(draw.choice(words) for _ in range(20_000)) + " ").encode()
    c = tox._CLASS[np.frombuffer(raw, np.uint8)]
    counts = np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3).astype(float)
    reader = tox.Restorer(tox.trigram_costs(counts))
    for text, word in (("stuupid", "stupid"), ("idiiot", "idiot"), ("trrash", "trash"), ("455", "ass"), ("@$$", "ass"),
                       ("4 5 5", "ass"), ("@ $ $", "ass"), ("id***t", "idiot"), ("you are a s t u p i d letter", "stupid"),
                       ("i  d  i  o  t", "idiot"), ("i\nd\ni\no\nt", "idiot"), ("i\td i   d 1 o t", "idiot"),
                       ("idiot!!!", "idiot"), ("***stupid***", "stupid"), ("stupid***", "stupid"), ("trash.***", "trash"), ("you-stupid-idiot", "stupid"), ("(trash", "trash")):
        assert word in reader.words(text), (text, reader.words(text))
    assert reader.words("letter ----- ===== *****") == {"letter"}
    assert reader.words("kabar locon!") == {"kabar", "locon"}
    assert "astupid" not in reader.words("you are a s t u p i d")


def test_license_scan(spark):
    from ledgerloom.llm.license_scan import TEMPLATES, license_scan

    mit = TEMPLATES["MIT grant"]
    edited = mit.replace("free of charge, ", "").replace("limitation", "any limitation")
    texts = CORNERS + [f"kabar locon {mit}. end", f"é ü {edited} tail", "Released under the MIT License.\nfoo",
                       "the MIT license was released under pressure", prose(random.Random(2), 300)]
    got = license_scan(frame(spark, texts)).collect()
    n = len(CORNERS)
    assert sorted((r.doc_id, r.license) for r in got) == [(n, "MIT grant"), (n + 1, "MIT grant"), (n + 2, "MIT notice")]
    full = next(r for r in got if r.doc_id == n)
    assert full.coverage == 1.0 and texts[n][full.start:full.end].startswith("Permission is")
    assert texts[n][full.start:full.end].split()[-1].startswith("Software")
    part = next(r for r in got if r.doc_id == n + 1)
    assert 0.9 < part.coverage < 1.0
    assert license_scan(frame(spark, [])).count() == 0


def test_license_of_every_template_and_edit():
    from ledgerloom.llm import license_scan as scan

    scanner = scan.Scanner(scan.TEMPLATES, 0.8)
    for name, template in scan.TEMPLATES.items():
        assert [m[:2] for m in scanner.scan(f"kabar {template} locon")] == [(name, 1.0)]
    draw = random.Random(6)
    for text in ("Released under the terms of the MIT License", "Released under our MIT License"):
        assert [m[0] for m in scanner.scan(f"kabar locon {text} locon")] == ["MIT notice"]
    # Any edit that leaves four fifths of the words is found, wherever it is.
    for trial in range(300):
        template = " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(draw.randint(5, 12)))
        w = template.split()
        for k in draw.sample(range(len(w)), len(w) // 5):
            w[k] = "edited"
        one = scan.Scanner({"t": template}, 0.8)
        got = one.scan(" ".join([prose(draw, 30), *w, prose(draw, 30)]))
        assert len(got) == 1 and got[0][1] >= 0.8, (template, w)


def local_alignment(template, text):
    """(score, matched words) of the best local alignment without a band, by the plain table."""
    best, before = (0, 0), [(0, 0)] * (len(text) + 1)
    for word in template:
        row = [(0, 0)]
        for j, other in enumerate(text):
            score, hits = before[j]
            pair = (score + 2, hits + 1) if word == other else (score - 1, hits)
            row.append(max((0, 0), pair, (before[j + 1][0] - 1, before[j + 1][1]), (row[j][0] - 1, row[j][1])))
        best, before = max(best, max(row)), row
    return best


def test_license_against_unbanded_alignment():
    from ledgerloom.llm import license_scan as scan

    draw = random.Random(8)
    found = 0
    for trial in range(250):
        words = [draw.choice(WORDS) + draw.choice("abc") for _ in range(draw.randint(4, 60))]
        text = list(words)
        for _ in range(draw.randint(0, max(1, len(words) // 5))):
            k = draw.randrange(len(text))
            text[k:k + draw.choice((0, 1, 1))] = draw.choice((["edited"], [draw.choice(WORDS)], []))
            text = text or ["edited"]
        text = [*(draw.choice(WORDS) for _ in range(20)), *text, *(draw.choice(WORDS) for _ in range(20))]
        want = local_alignment(words, text)[1]
        got = scan.Scanner({"t": " ".join(words)}, 0.8).scan(" ".join(text))
        if want >= 0.8 * len(words):
            found += 1
            assert got and max(m[2] for m in got) >= want, (words, text, want, got)
        else:
            assert all(m[1] >= 0.8 for m in got)
    assert found > 100


def test_license_index_is_winnowed():
    from ledgerloom.llm import license_scan as scan

    scanner = scan.Scanner(scan.TEMPLATES, 0.8)
    long = scanner.index[scan.GRAM, scan.WINDOW]
    every = sum(len(t) - scan.GRAM + 1 for t in scanner.templates.values() if scan.shared_run(len(t), 0.8) >= 4)
    assert 0.5 * every < sum(map(len, long.values())) < 0.8 * every
    # Any four words in a row of such a template share a fingerprint with it.
    name = "MIT license"
    numbers = [scanner.number[w] for w in scanner.templates[name]]
    for i in range(len(numbers) - 3):
        held = scanner.fingerprints(numbers[i:i + 4], scan.GRAM, scan.WINDOW)
        assert any((name, i + place) in long.get(code, ()) for place, code in held)


def test_whole_licenses_and_added_words():
    from ledgerloom.llm import license_scan as scan

    scanner = scan.Scanner(scan.TEMPLATES, 0.8)
    for name in ("MIT license", "ISC license", "BSD-2-Clause license", "BSD-3-Clause license"):
        whole = f"kabar {scan.TEMPLATES[name]} locon"
        assert [m[:2] for m in scanner.scan(whole)] == [(name, 1.0)]
        twice = scanner.scan(whole + " " + whole)
        assert [m[:2] for m in twice] == [(name, 1.0)] * 2
    words = scan.TEMPLATES["MIT warranty"].split()
    words[40:40] = [f"added{i}" for i in range(12)]
    assert [m[:2] for m in scanner.scan(" ".join(words))] == [("MIT warranty", 1.0)]
    folder = "/usr/share/common-licenses"
    if os.path.isdir(folder):
        bodies = {n: t for n, t in scan.read_templates(folder).items() if n in ("Apache-2.0", "MPL-2.0", "GPL-2", "GPL-3")}
        scanner = scan.Scanner(bodies, 0.8)
        for name, text in bodies.items():
            words = text.split()
            words[500:500] = ["added"] * 30
            del words[700:720]
            got = scanner.scan(f"kabar {' '.join(words)} locon")
            assert [m[0] for m in got] == [name] and 0.97 < got[0][1] < 1.0


def test_pipeline(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, folder).cache()
        assert after.columns == columns
        left, right = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert set(right) <= set(left)
        if name == "exact_dedup":
            last = {}
            for i, t in left.items():
                last[t] = max(i, last.get(t, -1))
            assert set(right) == set(last.values())
        if name == "ngram_jaccard_join":
            want = brute_components(list(left.values()), list(left))
            assert set(right) == {i for i in left if want[i][1] == i}
        if name == "pii":
            assert set(right) == set(left) and not any(plain_pii(t) for t in right.values())
        before = after
    packed = p.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(right)


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op7_ngram_jaccard_join", "op10_substring_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb
    from crosscheck import TABLES, rows_of

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    df = entry.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, res.fetchall())
