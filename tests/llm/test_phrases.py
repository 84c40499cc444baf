import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from quillveil.llm import phrases as P

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, top, absorbed=80):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in found.items():
            for sub in {p[i : i + n] for n in range(2, len(p)) for i in range(len(p) - n + 1)}:
                longest[sub] = max(longest[sub], a)
        scored = []
        for p, a in found.items():
            s, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * longest[p] < absorbed * a:
                scored.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_phrases_are_those_of_brute_force(spark, scratch):
    r = random.Random(1)
    words = ["of", "The", "a", "É", "über", "x1", "\U0001f600", "naïve"] + [f"w{i}" for i in range(60)]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words[: r.choice((6, 68))]) + r.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]) for _ in range(r.randrange(90)))) for _ in range(300)]
    rows += [("en", None), (None, ""), ("fr", " .,!"), ("en", "Yes no yes no yes no. ") ] + [("es", "la casa de la playa; la casa")] * 40
    rows += [("tm", f"{thue_morse(1024)} end")] * 5 + [("tm", f"{thue_morse(1024).translate(str.maketrans('ab', 'ba'))} end")] * 4
    rows += [("en", "long text here " * 20_000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "lang string, text string, phrase int")
    for least, top in ((5, 40), (1, 2000)):
        got = sorted(map(tuple, P.collocations(df, f"{scratch}{least}", least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
        assert got == brute(rows, least, top)
    assert P.collocations(df.limit(0), scratch + "none").collect() == []
    assert P.collocations(df.where("text = ''"), scratch + "empty").collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=12), st.integers(1, 12), st.integers(2, 9))
def test_summaries_keep_what_is_frequent(blocks, capacity, least):
    summary, true = P.Summary(capacity, least), Counter()
    for block in blocks:
        summary.add(np.sort(np.array(block, np.uint32)))
        true.update(block)
    kept = set(summary.survivors().tolist())
    assert {x for x, n in true.items() if n >= least} <= kept
    assert summary.taken < least
    assert summary.taken * (capacity + 1) <= sum(true.values())
    held = dict(zip((summary.held >> np.uint64(32)).tolist(), (summary.held & np.uint64(0xFFFFFFFF)).tolist(), strict=True))
    assert all(held.get(x, 0) <= n <= held.get(x, 0) + summary.taken for x, n in true.items())


def test_blocks_come_back():
    for values in ([0], [5, 5, 5], [0, 1, 1 << 31, (1 << 32) - 1], sorted(random.Random(2).choices(range(1 << 32), k=5000))):
        low = np.array(values, np.uint32)
        assert (P._unpack(len(low), P._pack(low)) == low).all()
