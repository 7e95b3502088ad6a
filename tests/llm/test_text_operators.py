import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gapwright.llm import decontam, langid, licenses, pieces, pii, simhash, substrings, toxicity
from gapwright.llm.common import split_words


def sentence(draw, n, words=None):
    words = words or [f"w{i}" for i in range(5000)]
    return " ".join(draw.choice(words) for _ in range(n))


# --- words


@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x1cab\x85é", max_size=20)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_split_words(texts):
    w = split_words(pa.array(texts, pa.string()))
    vocab = w.vocab.to_pylist()
    for i, t in enumerate(texts):
        assert [vocab[c] for c in w.codes[w.offsets[i] : w.offsets[i + 1]]] == re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- op3


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, budget=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= budget:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@given(st.text(alphabet="aAbÉé \t\n", max_size=60))
@settings(max_examples=80, deadline=None)
def test_simhash_value(text):
    assert simhash.simhash(text) == plain_simhash(text)


def test_near_duplicates_against_brute_force(docs_of, odd):
    draw = random.Random(0)
    base = [sentence(draw, 60) for _ in range(12)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = base[i % 3].split()
        words[draw.randrange(60)] = "zz"
        rows.append((200 + i, " ".join(words)))
    rows += odd
    got = simhash.near_duplicates(docs_of(rows)).collect()
    prints = [plain_simhash(t) for _, t in rows]
    root = plain_components(prints)
    want = sorted((str(i), f"{prints[k]:016x}", str(min((j for j, r in zip([x[0] for x in rows], root, strict=True) if r == root[k] and j is not None), default=None))) for k, (i, _) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


@pytest.mark.parametrize("block", [3, 20_000])
def test_links_lose_no_component(spark, block):
    """Random fingerprints around few centres; small blocks give the same components."""
    draw = np.random.default_rng(1)
    centres = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = []
    for c in centres:
        x = int(c)
        for _ in range(40):
            for b in draw.choice(64, int(draw.integers(0, 5)), replace=False):
                x ^= 1 << int(b)
            prints.append(x & ((1 << 64) - 1))
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    from gapwright.llm.components import connected

    found = {r["node"]: r["root"] for r in connected(simhash.near_links(df, block=block)).collect()}
    got = [found.get(p, p) for p in signed]
    want = plain_components(prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_hot_group_gives_no_pairs(docs_of):
    draw = random.Random(3)
    base = sentence(draw, 200).split()
    rows = []
    for i in range(400):
        words = list(base)
        words[draw.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(words)))
    prints = simhash.fingerprints(docs_of(rows))
    edges = simhash.near_links(prints).count()
    assert edges <= 10 * prints.select("fp").distinct().count()


def test_keep_first(docs_of, odd):
    rows = [(9, "a b c d e f g"), (8, "a b c d e f g"), (8, "a b c d e f g"), *odd]
    kept = simhash.keep_first(docs_of(rows)).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept)
    classes = simhash.near_duplicates(docs_of(rows)).select("component_id").distinct().count()
    assert len(ids) == classes and (False, 8) in ids and (False, 9) not in ids


def test_keep_first_leaves_clashing_columns_alone(spark):
    names = ["own", "first_id", "first_key", "__own", "__n", "__id", "__key", "root", "fp"]
    rows = [(1, "a b c d e f g", *range(9)), (2, "a b c d e f g", *range(9)), (3, "other words here and there again", *range(10, 19))] + [(3, "other words here and there again", *range(10, 19))] * 40
    df = spark.createDataFrame(rows, ["doc_id", "text", *names]).repartition(3)
    assert sorted(map(tuple, simhash.keep_first(df).collect())) == [rows[0], rows[2]]


def test_a_class_on_a_third_of_the_rows(docs_of):
    draw = random.Random(9)
    rows = [(i, "the same text of some words again" if i % 3 == 0 else sentence(draw, 30)) for i in range(900)]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert all(r["component_id"] == (0 if r["doc_id"] % 3 == 0 else r["doc_id"]) for r in got)


def test_empty_tables(docs_of, spark):
    none = docs_of([])
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_first(none).count() == 0
    assert substrings.dedup_passages(none).count() == 0
    assert licenses.scan(none).count() == 0
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(docs_of([(1, "a b c d e f")]), bench).count() == 0
    assert pii.pseudonymise(none, "k").count() == 0
    model = langid.train(none)
    assert langid.label(docs_of([(1, "abc")]), model).first()["lang_pred"] == "und"
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.score(docs_of([(1, "abc")]), toxicity.fit(none, labels)).count() == 1


# --- op1


def test_licenses(docs_of, odd):
    mit = dict(licenses.TEMPLATES)["MIT-text"].split()
    changed = [*mit[:30], "inserted", *mit[30:60], *mit[62:]]  # two words less
    rows = [(20, "x y z Released under the MIT license! more"), (21, "before " + " ".join(changed) + " after"), (22, "Released under the sun"),
            (23, "Licensed under CC BY-NC 4.0. and again licensed under cc by-nc 4.0"), *odd]
    got = licenses.scan(docs_of(rows)).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert set(by_id) == {20, 21, 23}
    assert (by_id[20][0]["template"], by_id[20][0]["first_word"], by_id[20][0]["end_word"]) == ("MIT", 3, 8)
    assert by_id[21][0]["template"] == "MIT-text" and by_id[21][0]["matched"] == len(mit) - 2 and by_id[21][0]["first_word"] == 1
    assert len(by_id[23]) == 2


def test_alignment_against_full_table():
    draw = random.Random(5)
    for _ in range(60):
        t = [draw.randrange(4) for _ in range(draw.randint(1, 8))]
        x = [draw.randrange(4) for _ in range(draw.randint(1, 12))]

        def best(i, j, t=t, x=x):  # global in t, free ends in x
            n, m = len(t), len(x)
            table = [[0] * (m + 1) for _ in range(n + 1)]
            for a in range(1, n + 1):
                for b in range(m + 1):
                    options = [table[a - 1][b] - 1]
                    if b:
                        options += [table[a - 1][b - 1] + (2 if t[a - 1] == x[b - 1] else -1), table[a][b - 1] - 1]
                    table[a][b] = max(options)
            return max(table[n])

        m = licenses.align(t, x, 0, 30)
        score = best(0, 0)
        assert 2 * m.matched >= score  # what agrees pays for all that does not
        assert 0 <= m.first <= m.end <= len(x)


def plain_coverage(template, text):
    """Agreeing words of the best alignment of the whole template anywhere in the text, any band."""
    n, m = len(template), len(text)
    score = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for a in range(1, n + 1):
        for b in range(m + 1):
            options = [(score[a - 1][b][0] - 1, score[a - 1][b][1])]
            if b:
                same = template[a - 1] == text[b - 1]
                options += [(score[a - 1][b - 1][0] + (2 if same else -1), score[a - 1][b - 1][1] + same), (score[a][b - 1][0] - 1, score[a][b - 1][1])]
            score[a][b] = max(options)
    return max(score[n])[1]


def test_licenses_against_brute_force(docs_of):
    """Notices changed up to the least coverage: short ones are all found, long ones nearly all."""
    draw = random.Random(2)
    index = licenses.Index(licenses.TEMPLATES)
    rows, want = [], {}
    for name, text in licenses.TEMPLATES:
        words, k = text.split(), index.ids.index(name)
        musts = set(index.musts[k])
        for _ in range(25):
            n = len(words)
            free = [p for p in range(n) if p not in musts]
            gone = set(draw.sample(free, min(len(free), draw.randint(0, n - -(-4 * n // 5)))))
            new = [("zq1" if draw.random() < 0.5 else None) if p in gone else w for p, w in enumerate(words)]
            new = [w for w in new if w is not None]
            new.insert(draw.randrange(1, len(new)), "zq2")
            i = len(rows)
            rows.append((i, " ".join([sentence(draw, 6), *new, sentence(draw, 6)])))
            want[i] = (name, plain_coverage(plain_words(text), plain_words(rows[i][1])), index.short[k], n)
    found = {}
    for r in licenses.scan(docs_of(rows)).collect():
        found.setdefault(r["doc_id"], []).append((r["template"], r["matched"]))
    long_ = [(i, w) for i, w in want.items() if not w[2]]
    for i, (name, matched, short, n) in want.items():
        if short and matched >= 0.8 * n:
            # the notice itself, or one that agrees in as many words
            assert any(t == name or m >= matched for t, m in found.get(i, [])), (name, rows[i])
    caught = [any(t == name or m >= matched for t, m in found.get(i, [])) for i, (name, matched, _, n) in long_ if matched >= 0.8 * n]
    assert len(caught) > 300 and sum(caught) >= 0.98 * len(caught)
    for i, t in ((0, "Released under the new MIT License."), (1, "This work is licensed under the GNU General Public License, version 2.")):
        assert [r["template"] for r in licenses.scan(docs_of([(i, t)])).collect()] == [["MIT", "GPL-2.0"][i]]
    assert licenses.scan(docs_of([(0, "Released under the XYZ License. Released under the sun by me.")])).count() == 0


def test_sibling_licenses_are_told_apart(docs_of):
    texts = dict(licenses.TEMPLATES)
    names = [n for n in texts if n.endswith(("-text", "-header", "-id")) or n.startswith(("CC", "GPL", "LGPL", "AGPL", "BSD"))]
    got = {r["doc_id"]: (r["template"], r["coverage"]) for r in licenses.scan(docs_of([(i, f"intro {texts[n]} end") for i, n in enumerate(names)])).collect()}
    assert got == {i: (n, 1.0) for i, n in enumerate(names)}


def test_ten_thousand_notices_in_one_text(docs_of):
    import time

    start = time.time()
    assert licenses.scan(docs_of([(1, "Released under the MIT License. " * 10_000)], 1)).count() == 10_000
    assert time.time() - start < 30


def test_winnow_keeps_one_in_every_window():
    h = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    places = licenses.winnow(h, 4)
    assert all(((places >= i) & (places < i + 4)).any() for i in range(197))


# --- op2


def plain_tiles(text, item, shortest):
    """Greedy string tiling by trying all matches."""
    used_t, used_i, tiles = set(), set(), []
    while True:
        best = None
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while t + n < len(text) and i + n < len(item) and text[t + n] == item[i + n] and t + n not in used_t and i + n not in used_i:
                    n += 1
                if n >= shortest and (best is None or (-n, t, i) < best):
                    best = (-n, t, i)
        if best is None:
            return tiles
        n, t, i = -best[0], best[1], best[2]
        tiles.append((t, i, n))
        used_t |= set(range(t, t + n))
        used_i |= set(range(i, i + n))


def test_tiling_against_plain():
    draw = random.Random(7)
    for _ in range(150):
        text = np.array([draw.randrange(3) for _ in range(draw.randint(3, 25))], dtype=np.uint64)
        item = np.array([draw.randrange(3) for _ in range(draw.randint(3, 14))], dtype=np.uint64)
        want = plain_tiles(text.tolist(), item.tolist(), 3)
        assert decontam.tile(text, item, 3) == want
        seeds = [t for t in range(len(text) - 2) for i in range(len(item) - 2) if (text[t : t + 3] == item[i : i + 3]).all()]
        usable = np.array([any(t - 2 <= s <= t for s in seeds) for t in range(len(text))])
        assert decontam.tile(text, item, 3, usable) == want


def test_running_hashes_tell_windows_apart():
    draw = np.random.default_rng(3)
    for size in (5, 9, 40):
        tokens = draw.integers(0, 1 << 63, 4, dtype=np.uint64)[draw.integers(0, 2, 300)]
        found = decontam.karp_rabin(tokens, size).tolist()
        windows = [tuple(tokens[i : i + size].tolist()) for i in range(len(tokens) - size + 1)]
        assert len(set(found)) == len(set(windows)) == len(set(zip(found, windows, strict=True)))


def plain_words(text):
    return [re.sub(r"^[^\w]+|[^\w]+$", "", w) or w for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]


def plain_contaminated(rows, items, shortest=5, coverage=0.5):
    found = []
    for i, t in rows:
        for k, item in items:
            want = plain_words(item)
            have = plain_words(t)
            if len(want) >= shortest and len(have) < 2000:
                covered = sum(n for _, _, n in plain_tiles(have, want, shortest))
                if covered >= coverage * len(want):
                    found.append((str(i), k, covered))
    return sorted(found)


def test_contamination_against_brute_force(docs_of, spark, odd):
    """Shuffled, changed and repeated passages over few words, repeated items and an opening that many items share."""
    draw = random.Random(23)
    words = [f"v{i}" for i in range(12)]
    opening = sentence(draw, 8, words)
    items = [(i, opening + " " + sentence(draw, draw.randint(0, 14), words)) for i in range(12)]
    items += [(100 + i, items[0][1]) for i in range(5)]
    rows = []
    for i in range(40):
        w = draw.choice(items)[1].split()
        cut = draw.randrange(len(w))
        rows.append((i, " ".join([sentence(draw, 4, words), *w[cut:], sentence(draw, 2, words), *w[:cut], opening if i % 3 else ""])))
    rows += odd
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (32 << 20, 200):
        got = decontam.contaminated(docs_of(rows), bench, block_bytes=size).collect()
        assert sorted((str(r["doc_id"]), r["item_id"], r["covered"]) for r in got) == plain_contaminated(rows, items)


def test_a_seed_that_very_many_items_share(docs_of, spark):
    import time

    draw = random.Random(5)
    opening = sentence(draw, 10)
    index = decontam.Index(list(range(20_000)), [f"{opening} " + " ".join(f"q{i}x{j}" for j in range(30)) for i in range(20_000)], 5, 0.5)
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": [f"{opening} {sentence(draw, 20)}" for _ in range(100)]})
    start = time.time()
    assert decontam._matches(rows, index, 0.5) is None
    assert time.time() - start < 4  # of 100 texts


def test_contamination(docs_of, spark, odd):
    draw = random.Random(11)
    items = [(i, sentence(draw, 30)) for i in range(6)]
    bench = spark.createDataFrame([*items, (6, None), (7, ""), (8, "a b")], "item_id bigint, text string")
    w = items[0][1].split()
    moved = " ".join([*w[20:], "zzz", *w[:10], "yyy", *w[10:20]])
    rows = [(50, sentence(draw, 40) + " " + items[2][1].upper() + ". " + sentence(draw, 9)), (51, moved), (52, " ".join(w[:12])), (53, sentence(draw, 90)), *odd]
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs_of(rows), bench).collect()}
    assert set(got) == {(50, 2), (51, 0)}
    assert got[51, 0]["coverage"] == 1.0 and got[51, 0]["tiles"] == 3
    in_blocks = decontam.contaminated(docs_of(rows), bench, block_bytes=100)
    assert {(r["doc_id"], r["item_id"]) for r in in_blocks.collect()} == set(got)
    kept = sorted(str(r["doc_id"]) for r in decontam.clean(docs_of(rows), bench).collect())
    assert kept == sorted(str(i) for i, _ in rows if i not in (50, 51))
    assert decontam.clean(docs_of(rows), bench, block_bytes=100).count() == len(kept)


# --- op4


@given(st.integers(1, 5000), st.binary(min_size=1, max_size=8), st.data())
@settings(max_examples=40, deadline=None)
def test_feistel_is_a_permutation(size, key, data):
    if size < 300:
        assert sorted(pii.Keyed(key)(x, size, "t") for x in range(size)) == list(range(size))
    else:
        a, b = (data.draw(st.integers(0, size - 1)) for _ in "ab")
        assert (pii.Keyed(key)(a, size, "t") == pii.Keyed(key)(b, size, "t")) == (a == b)
        assert pii.Keyed(key, back=True)(pii.Keyed(key)(a, size, "t"), size, "t") == a


def test_pii_formats():
    key = b"secret"
    for text, kind, shape in [
        ("4111 1111 1111 1111", "card", r"\d{4} \d{4} \d{4} \d{4}"), ("2021-02-28", "date", r"\d{4}-\d\d-\d\d"), ("31.12.1999", "date", r"\d\d\.\d\d\.\d{4}"),
        ("DE89 3704 0044 0532 0130 00", "iban", r"DE\d\d( \d{4}){4} \d\d"), ("123-45-6789", "ssn", r"\d{3}-\d\d-\d{4}"), ("+1 (743) 555-3824", "phone", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        ("10.20.30.40", "ip", r"\d{1,3}(\.\d{1,3}){3}"), ("Ann.Lee7@mail5.example.com", "email", r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@[a-z]{4}\d\.[a-z]{7}\.com"),
        ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "secret", r"[0-9a-f]{40}"),
    ]:
        new, counts = pii.pseudonyms(f"see {text}, ok", key)
        assert counts == {kind: 1} and re.fullmatch(f"see {shape}, ok", new) and text not in new
        again, _ = pii.pseudonyms(f"{text}", key)
        assert again == new[4:-4]
        assert pii.pseudonyms(text, b"other")[0] != again
    card = pii.pseudonyms("4111111111111111", key)[0]
    assert pii.luhn(card) and pii._iban(pii.pseudonyms("GB82WEST12345698765432", key)[0], pii.Keyed(key))
    for plain in ("4111111111111112", "2021-02-30", "256.1.1.1", "000-12-3456", "version 1.2.3", "in 1984 and 2000", "DE89370400440532013001"):
        assert pii.pseudonyms(plain, key) == (plain, {})


def test_pii_beside_other_digits_and_capitals():
    key = b"secret"
    card, iban, phone = "4111111111111111", "ES9121000418450200051332", "+1 (663) 555-6869"
    spaced, long = "4111 1111 1111 1111", "4111-1111-1111-1111"
    for text, value in [
        (f"{card} 12/27", card), (f"{spaced} 123", spaced), (f"7 {card}", card), (f"{long}-123", long), (f"{long}-1234", long), (f"12 35 {card} 99 98", card),
        (f"{iban} BIC", iban), (f"XX12 3456 7890 {iban}", iban), ("GB82 WEST 1234 5698 7654 32 BANK NAME", "GB82 WEST 1234 5698 7654 32"),
        (f"{phone} 2024", phone), (f"{phone} 12", phone), (f"{phone} 20245", phone), ("+16635556869 12", "+16635556869"), (f"000-12-3456 {card}", card),
    ]:
        alone, counts = pii.pseudonyms(value, key)
        assert sum(counts.values()) == 1 and alone != value
        assert pii.pseudonyms(text, key) == (text.replace(value, alone), counts), text
    assert pii.pseudonyms(f"{card} {card}", key)[1] == {"card": 2}
    assert pii.pseudonyms(f"{card}.5", key) == (f"{card}.5", {})


def test_long_values_leave_no_place_unchanged():
    """No position of a long value survives more often than chance has it."""
    draw = random.Random(1)
    for make, chance in (
        (lambda: "".join(draw.choice("0123456789abcdef") for _ in range(128)), 1 / 16),
        (lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(64)) + "@a.org", 1 / 26),
    ):
        same = np.zeros(128)
        for _ in range(1000):
            value = make()
            new, counts = pii.pseudonyms(value, b"k")
            assert sum(counts.values()) == 1
            same += [a == b for a, b in zip(value.split("@")[0].ljust(128), new.split("@")[0].ljust(128, "-"), strict=True)]
        assert same.max() < 1000 * chance + 6 * (1000 * chance) ** 0.5


def test_dates_stay_apart_and_linked_across_notations():
    key, days = b"k", [pii.FIRST_DAY.fromordinal(pii.FIRST_DAY.toordinal() + 7 * i) for i in range(5000)]
    seen = {}
    for d in days:
        forms = [f"{d:%Y-%m-%d}", f"{d:%d/%m/%Y}"] + ([f"{d:%m/%d/%Y}"] if d.day > 12 else [])
        out = [pii.pseudonyms(x, key)[0] for x in forms]
        new = {(x[:4], x[5:7], x[8:]) if "-" in x else (x[6:], x[3:5], x[:2]) for x in out[:2]} | {(x[6:], x[:2], x[3:5]) for x in out[2:]}
        assert len(new) == 1
        assert seen.setdefault(new.pop(), d) == d


def test_pseudonyms_can_be_put_back(docs_of, odd):
    """An exact round trip over whole texts; what is no personal data stays."""
    draw = random.Random(4)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        return body + pii._luhn_digit(body)

    makers = [
        card, lambda: f"user{digits(3)}@mail{digits(2)}.example.org", lambda: f"20{digits(2)}-0{draw.randint(1, 9)}-1{draw.randint(0, 9)}", lambda: f"10.{draw.randint(0, 255)}.3.{draw.randint(0, 255)}",
        lambda: f"+1 (2{digits(2)}) 555-{digits(4)}", lambda: f"12{draw.randint(1, 9)}-45-{draw.randint(1000, 9999)}", lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40)),
    ]
    rows, values = [], {}
    for i in range(100):
        found = [draw.choice(makers)() for _ in range(5)]
        values[100 + i] = found
        rows.append((100 + i, " ; ".join(f"{sentence(draw, 4, ['some', 'plain', 'words', 'here'])} {x}" for x in found)))
    df = docs_of([*rows, *odd])
    there = pii.pseudonymise(df, "k", counts_col="found").collect()
    text = dict(rows)
    for r in there:
        if r["doc_id"] in values:
            parts = [x.rsplit(" ", 1) if "(" not in x else [x.split(" +")[0], "+" + x.split(" +")[1]] for x in r["text"].split(" ; ")]
            plain = [x[: len(x) - len(v) - 1] for x, v in zip(text[r["doc_id"]].split(" ; "), values[r["doc_id"]], strict=True)]
            assert sum(r["found"].values()) == 5 and [p for p, _ in parts] == plain
            for (_, new), old in zip(parts, values[r["doc_id"]], strict=True):
                assert new != old and len(new.split(".")) == len(old.split(".")) and re.sub("[0-9a-f]", "x", new.lower()).count("x") >= 4
                assert new == pii.pseudonyms(old, b"k")[0]
    back = pii.pseudonymise(pii.pseudonymise(df, "k"), "k", back=True).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in back) == sorted((str(i), str(t)) for i, t in [*rows, *odd])


def test_pii_table(docs_of, odd):
    rows = [(30, "call +1 (743) 555-3824"), (31, "or +1 (743) 555-3824 now"), *odd]
    df = docs_of(rows)
    got = pii.pseudonymise(df, "k", counts_col="found").collect()
    assert len(got) == len(rows)
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[30][5:] == text[31][3:-4] != "+1 (743) 555-3824"
    for r in got:
        if r["doc_id"] in (1, 2, 3, 5, 6, 7):
            assert r["text"] == dict(odd)[r["doc_id"]]
    assert pii.pseudonymise(df, "k").columns == df.columns
    for bad in ("", "x" * 65):
        with pytest.raises(ValueError):
            pii.pseudonymise(df, bad)
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "k", counts_col="lang")


# --- op5


def plain_segments(s):
    out = []

    def find(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > 0 and (best is None or total > best[2] + 1e-12):
                    best = (i, j + 1, total)
        if best:
            find(a, best[0])
            out.append(best)
            find(best[1], b)

    find(0, len(s))
    return out


def test_all_maximal_segments():
    draw = np.random.default_rng(0)
    for _ in range(200):
        s = draw.normal(-0.2, 1, draw.integers(0, 15))
        assert [x[:2] for x in toxicity.segments(s)] == [x[:2] for x in plain_segments(s)]


def test_toxicity_learns_and_never_reads_ids(docs_of, spark, odd):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = sentence(draw, 80).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(6):
                words[draw.randrange(80)] = draw.choice(["vile", "nasty!", "Rotten"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs_of(rows), table)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(rows), model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    moved = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of([(i + 1000, t) for i, t in rows]), model).collect()}
    assert all(abs(moved[i + 1000] - got[i]) < 1e-12 for i in got)
    assert toxicity.score(docs_of(odd), model).count() == len(odd)
    spot = toxicity.score(docs_of([(1, sentence(draw, 50) + " vile nasty rotten vile " + sentence(draw, 50))]), model).first()["passages"]
    assert len(spot) == 1 and spot[0]["first"] == 50 and spot[0]["words"] == 4


# --- op6


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(0)
    lengths = draw.integers(0, 7, 40)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    score = draw.normal(size=(offsets[-1], 3)).astype(np.float32) * 3
    path = langid.viterbi(score, offsets, 2.0)

    def value(s, labels):
        return sum(s[i, k] for i, k in enumerate(labels)) - 2.0 * sum(a != b for a, b in itertools.pairwise(labels))

    for a, b in itertools.pairwise(offsets):
        if b > a:
            best = max(value(score[a:b], p) for p in itertools.product(range(3), repeat=b - a))
            assert abs(value(score[a:b], path[a:b]) - best) < 1e-4


def test_language_spans_and_scripts(docs_of, odd):
    draw = random.Random(1)
    words = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["zhaba", "krok", "vzdor", "chrt"], "el": ["αβγ", "δεζ", "ηθικ"]}
    rows = [(i, sentence(draw, 30, words[k]), k) for i, k in enumerate(["xx", "yy", "el"] * 30)]
    model = langid.train(docs_of(rows))
    assert model.langs == ["el", "xx", "yy"]
    mixed = sentence(draw, 40, words["xx"]) + " " + sentence(draw, 20, words["yy"]) + " 123 !!! " + sentence(draw, 10, words["el"])
    r = langid.label(docs_of([(900, mixed)]), model).first()
    assert r["lang_pred"] == "xx" and [s["lang"] for s in r["spans"]] == ["xx", "yy", "el"] and abs(r["score"] - 40 / 70) < 1e-9
    assert [s["first"] for s in r["spans"]][:2] == [0, 40] and sum(s["words"] for s in r["spans"]) == 72
    assert langid.label(docs_of([(1, "ωωω")]), model).first()["lang_pred"] == "el"
    got = {str(x["doc_id"]): x for x in langid.label(docs_of(odd), model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["spans"] == [] for k in ("1", "2", "3"))
    assert langid.filter_known(docs_of([*odd, (70, "123 ...")]), model).count() == 6
    held = [(i, t, k) for i, t, k in rows]
    right = langid.label(docs_of(held), model).join(docs_of(held).select("doc_id", "lang"), "doc_id").where("lang = lang_pred").count()
    assert right == len(held)


def plain_languages(docs, penalty=12.0):
    """(lang, share) of every text: trigram counts in dictionaries, Viterbi over all label pairs."""
    import math
    import zlib

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def grams(w):
        p = [ord(c) for c in f" {w.lower()} "]
        out = []
        for a, b, c in zip(p, p[1:], p[2:], strict=False):
            h = a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35
            out.append((h ^ (h >> 15)) & (langid.BUCKETS - 1))
        return out

    def script(w):
        def one(c):
            if not c.isalpha():
                return 0
            return next((i + 2 for i, (_, low, high) in enumerate(langid.SCRIPTS) if low <= ord(c) <= high), 1)

        return max(map(one, w.lower()))

    count, scripts = {}, {}
    for i, t, lang in docs:
        if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            for w in words(t):
                for g in grams(w):
                    count.setdefault(lang, {})[g] = count.setdefault(lang, {}).get(g, 0) + 1
                scripts.setdefault(lang, {})[script(w)] = scripts.setdefault(lang, {}).get(script(w), 0) + 1
    langs = sorted(count)
    total = {x: sum(count[x].values()) + 0.1 * langid.BUCKETS for x in langs}
    lettered = {x: sum(n for k, n in scripts[x].items() if k) for x in langs}
    out = []
    for _, t, _ in docs:
        rows, real = [], []
        for w in words(t):
            k = script(w)
            real.append(k > 0)
            score = [sum(math.log((count[x].get(g, 0) + 0.1) / total[x]) for g in grams(w)) for x in langs]
            can = [scripts[x].get(k, 0) >= 0.01 * max(lettered[x], 1) for x in langs]
            top = max(score)
            score = [s - top if c or not any(can) else -50.0 for s, c in zip(score, can, strict=True)]
            top = max(score)
            rows.append([max(s - top, -50.0) if k else 0.0 for s in score])
        if not any(real) or not langs:
            out.append(("und", 0.0))
            continue
        best, back = rows[0], []
        for row in rows[1:]:
            came = [max(range(len(langs)), key=lambda a, b=b: (best[a] - penalty * (a != b), a == b, -a)) for b in range(len(langs))]
            back.append(came)
            best = [best[a] - penalty * (a != b) + row[b] for b, a in enumerate(came)]
        path = [best.index(max(best))]
        for came in reversed(back):
            path.append(came[path[-1]])
        votes = [0] * len(langs)
        for label, yes in zip(reversed(path), real, strict=True):
            votes[label] += yes
        out.append((langs[votes.index(max(votes))], max(votes) / sum(votes)))
    return out


def test_languages_against_brute_force(docs_of, odd):
    draw = random.Random(17)
    stems = {"aa": "kumo tela riva sando mire palto", "bb": "хата небо зима мова слово", "cc": "thorn wegh stral kronk bluft", "dd": "μέρα νύχτα θάλασσα γη"}
    word = lambda x: draw.choice(stems[x].split()) + draw.choice(["", "s", ",", "42"])
    docs = []
    for i in range(80):
        lang, other = draw.choice(list(stems)), draw.choice(list(stems))
        n = draw.randint(1, 30)
        docs.append((i, " ".join([*(word(lang) for _ in range(n)), *(word(other) for _ in range(draw.choice([0, 0, 1, 8]))), *(["12", "--"] * draw.randint(0, 2))]), lang if draw.random() < 0.9 else None))
    docs += [(i, t, None) for i, t in odd if t is None or len(t) < 1000]
    df = docs_of(docs)
    want = plain_languages(docs)
    got = langid.label(df, langid.train(df)).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in got) == sorted((str(d[0]), x, round(s, 6)) for d, (x, s) in zip(docs, want, strict=True))


# --- op9


def plain_dedup(rows, window):
    first = {}
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in tokens:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(i, first.get(k, i))
    out = []
    for i, w in tokens:
        gone = [False] * len(w)
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "alphabet", "seed"), [(8, 2, 0), (12, 3, 1), (50, 2, 2), (50, 5000, 3), (10, 1, 4)])
def test_passages_against_brute_force(docs_of, odd, window, alphabet, seed):
    """Small alphabets give runs and periods, the hard cases of the parsing."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(alphabet)]
    rows = [(i, sentence(draw, draw.randint(0, 150), words)) for i in range(12)]
    shared = sentence(draw, 70, words)
    rows += [(20 + i, f"{sentence(draw, draw.randint(0, 30), words)} {shared} {sentence(draw, draw.randint(0, 30), words)}") for i in range(6)]
    rows += [(40, "ab " * 120), (41, "ab " * 90 + "c"), (42, rows[0][1]), (42, rows[1][1]), *odd]
    got = substrings.dedup_passages(docs_of(rows), window=window).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == plain_dedup(rows, window)


def test_pieces_of_long_texts_do_not_matter(docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 64)
    draw = random.Random(9)
    lengths = np.array([0, 500, 49, 50, 130])
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    seen = {}
    for index, piece, rows, firsts in substrings._pieces(lengths, offsets, 50):
        for k, (row, first) in enumerate(zip(rows, firsts, strict=True)):
            n = int((piece == k).sum())
            for p in range(first, first + n - 49):
                assert (row, p) not in seen
                seen[row, p] = index[piece == k][p - first]
    assert set(seen) == {(r, p) for r in (1, 3, 4) for p in range(lengths[r] - 49)}
    assert draw


def test_hashes_of_patterns_that_defeat_powers_of_two():
    bits = np.array([bin(i).count("1") & 1 for i in range(1024)])
    hashes = tuple(np.random.default_rng(s).integers(0, 1 << 63, 2, dtype=np.uint64) for s in (1, 2))
    rolling = substrings.Rolling(hashes, np.concatenate([bits, 1 - bits, bits]))
    at = np.array([0, 1024, 2048])
    one, two = rolling.of(at, at + 1024)
    assert one[0] == one[2] and two[0] == two[2] and two[0] != two[1]


# --- op10


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def plain_paths(text, v):
    edges, _ = pieces.forward(text, v)
    out = []

    def walk(at, cost, ids):
        if at == len(text):
            out.append((cost, tuple(ids)))
        for s, e, piece, c in edges:
            if s == at:
                walk(e, cost + c, ids + (list(piece) if isinstance(piece, tuple) else [piece]))

    walk(0, 0, [])
    return sorted(out)


@pytest.mark.parametrize("text", [" the", " hello", "aaaa", " éß▁x", " 日本", " worth"])
def test_nbest_against_all_paths(vocabulary, text):
    want = plain_paths(text, vocabulary)
    for n in (1, 2, 5, 10_000):
        got = pieces.nbest(text, n, vocabulary)
        assert [c for c, _ in got] == [c for c, _ in want[:n]] and len(set(got)) == len(got) and all(x in want for x in got)
    cost, ids, gap = pieces.best_and_gap(text, vocabulary)
    assert (cost, ids) in want and cost == want[0][0] and gap == (want[1][0] - cost if len(want) > 1 else -1)


@given(st.text(alphabet="ab  é▁\n\t日x", max_size=14))
@settings(max_examples=40, deadline=None)
def test_segmentations_of_whole_texts(vocabulary, text):
    s = pieces.Segmenter(vocabulary, 4)
    got = s.all(text)
    assert all(pieces.decode(ids, vocabulary) == text for _, ids in got)
    assert len({tuple(ids) for _, ids in got}) == len(got)
    if text and len(text) < 9:
        assert [c for c, _ in got] == [c for c, _ in plain_paths(" " + text, vocabulary)[:4]]


def test_words_side_by_side_equal_single_ones(vocabulary):
    draw = random.Random(0)
    words = ["".join(draw.choice(" abcdeé!Ωthion") for _ in range(draw.randint(1, 26))) for _ in range(500)]
    s = pieces.Segmenter(vocabulary, 2)
    s.prepare(words)
    for w in s.known:
        cost, ids, gap = pieces.best_and_gap(w, vocabulary)
        k = s.known[w]
        assert (s.score[k] << pieces.COUNT_BITS) + s.weight[k] == cost and (s.gap[k] == gap or (gap < 0 and s.gap[k] == pieces.NO_GAP))
        assert tuple(s.spelt[s.first[k] : s.first[k] + s.count[k]]) == ids == pieces.nbest(w, 1, vocabulary)[0][1]


def plain_scores(text, n, path=pieces.MODEL_PATH):
    """The n best scores of a text and the pieces of its best one, from the model file alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score, least = {}, 0.0
    for i in range(model.get_piece_size()):
        least = min(least, model.get_score(i))
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            score[model.id_to_piece(i).replace("▁", " ")] = model.get_score(i)
    longest = max(map(len, score))
    text = " " + text if text else ""
    best = [[(0.0, 0)]]
    for e in range(1, len(text) + 1):
        found = []
        for s in range(max(0, e - longest), e):
            if text[s:e] in score:
                found += [(x - score[text[s:e]], k + 1) for x, k in best[s]]
            elif e == s + 1:
                found += [(x - least + 10, k + len(text[s].encode())) for x, k in best[s]]
        best.append(sorted(found)[:n])
    return [-x for x, _ in best[-1]], best[-1][0][1]


def test_digest_against_the_model_file(docs_of, vocabulary):
    draw = random.Random(6)
    letters = "etaoin shrdlu\n éß漢☃9.,"
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.randint(0, 80)))) for i in range(25)] + [(90, None), (91, "")]
    for r in pieces.digest(docs_of(rows), vocabulary).collect():
        scores, n = plain_scores(dict(rows)[r["doc_id"]] or "", 3)
        assert r["scores"] == pytest.approx(scores) and r["round_trip"] and r["nbest_sha256"][0] == r["ids_sha256"]
        assert len(set(r["nbest_sha256"])) == len(r["scores"]) and (r["n_pieces"] == n or len(scores) > 1 and scores[0] == scores[1])


def test_very_many_pieces_without_a_space(vocabulary):
    s = pieces.Segmenter(vocabulary, 2)
    text = "é☃" * 40_000
    cost, ids = s.ways(s.prepare([text])[0])[0]
    assert len(ids) > 65_536 and pieces.decode(ids.tolist(), vocabulary) == text
    one = pieces.Segmenter(vocabulary, 1)
    part = one.ways(one.prepare(["é☃" * 400])[0])[0][0]
    assert abs(pieces.score_of(cost, vocabulary) / pieces.score_of(part, vocabulary) - 100) < 0.5


def test_pieces_table(docs_of, vocabulary, odd):
    rows = [(60, "The cat\nsat  down."), *odd]
    got = pieces.digest(docs_of(rows), vocabulary).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    coded = pieces.encode(docs_of(rows), vocabulary, n=2)
    best = coded.selectExpr("doc_id", "segmentations[0].ids as ids").where("doc_id = 60")
    assert pieces.decode_column(best, vocabulary).first()["text"] == "The cat\nsat  down."
    want = {r["doc_id"]: r["n_pieces"] for r in got}
    assert len(best.first()["ids"]) == want[60]
    assert coded.where("doc_id = 1").first()["segmentations"] is None
