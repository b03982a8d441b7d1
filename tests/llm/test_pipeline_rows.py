"""All rows of the pipeline's run() against five stages in plain Python."""

import collections
import hashlib
import math
import random
import re

from test_llm import components, grams, prose
from tidelog.llm import line_rules, queries, secrets

WORD = re.compile("[^\x20\x09-\x0d]+")


def quality(t):
    """A document's text after the line rules, or None where it is rejected."""
    t = t or ""
    words = WORD.findall(t)
    at = collections.defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    again = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]

    def fails(x):
        count = lambda p: 100 * len(re.findall(p, x))
        short = len(WORD.findall(x)) <= 4 and not re.search(line_rules.ENDINGS, x, re.ASCII)
        dense = len(x) >= 20 and (count(line_rules.LINE_SYMBOLS) >= 10 * len(x) or count("[!?]") >= 12 * len(x))
        return bool(short or dense or len(re.findall(line_rules.SEPARATOR, x)) >= 3 or re.match(line_rules.NAVIGATION, x, re.ASCII) or re.search(line_rules.BOILERPLATE, x))

    good = [x for x in lines if not fails(x)]
    whole, left = len("".join(lines)), len("".join(good))
    if len(words) < 10 or 100 * len(again) > 20 * len(words) or (whole - left) * 100 > whole * 40:
        return None
    return t if len(good) == len(lines) else "\n".join(good)


def redact(texts, sources):
    held = collections.defaultdict(set)
    spans = {}
    for i, t in texts.items():
        spans[i] = []
        for _, pattern, group, least in secrets.PATTERNS:
            spans[i] += [(m.end() - len(m[group]), m.end(), m[group]) for m in re.finditer(pattern, t) if len(m[group]) >= least]
        for *_, v in spans[i]:
            held[v].add(sources[i])
    live = lambda v: len(v) >= 16 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not re.search(secrets.PLACEHOLDER, v) and len(set(v)) >= 8
    out = {}
    for i, t in texts.items():
        parts, end = [], 0
        for s, e, v in sorted(spans[i]):
            if s >= end:
                parts += [t[end:s], "<secret>" if len(held[v]) == 1 and live(v) else "<copied-secret>"]
            end = max(end, e)
        out[i] = "".join(parts) + t[end:]
    return out


def copies(texts, sources):
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    total = collections.Counter()
    for i, n in size.items():
        total[sources[i]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * total[s]}
        goal |= {s: 2.0 * total[s] for s in over} if over else share
        left -= sum(2 * total[s] for s in over)
        open_ = open_ - over if over else set()
    out = {}
    for s in names:
        own = sorted((n, i) for i, n in size.items() if sources[i] == s)
        assert len({n for n, _ in own}) == len(own) and all(n * 100 > goal[s] for n, _ in own)  # sizes differ, all are large
        mean = total[s] / len(own)
        rate = lambda n, lam: 2 / (1 + math.exp(-lam * n / mean))
        lo, hi = -200.0, 200.0
        for _ in range(300):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(rate(n, mid) * n for n, _ in own) < goal[s] else (lo, mid)
        at = 0
        for n, i in own:
            unit = 2 << 20 if goal[s] >= 2 * total[s] * (1 - 1e-12) else round(rate(n, lo) * (1 << 20))
            out[i] = (at + unit + (1 << 19) >> 20) - (at + (1 << 19) >> 20)
            at += unit
    return out


def test_run_is_five_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(8)
    own, shared = "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "0a1b2c3d4e5f60718293a4b5c6d7e8f9"
    rows = []
    for k in range(24):
        text = "\n".join(prose(100 * k + j, 12 + k % 5) for j in range(3 + k // 3))
        rows.append((k, text, ["a", "b", "c", None][k % 4]))
    rows += [(30 + k, rows[k][1] + f" x{k}", "a") for k in range(0, 24, 6)]  # near copies
    rows += [(40, rows[3][1], "b"), (41, "short", "a"), (42, None, "b"), (43, "", None), (44, "a b c d e f " * 20, "a"), (45, "Home | About | Menu | FAQ\n" * 9 + prose(5, 12), "c")]
    rows += [(50, prose(501, 43) + f'\nHome\ntoken = "{own}" {prose(502, 13)}', "a"), (51, prose(503, 45) + f" secret={shared} {prose(504, 12)}", "b"), (52, prose(505, 47) + f" password: {shared} {prose(506, 15)}", "c"), (53, prose(507, 50) + " api_key=password " + prose(508, 16), "a")]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = collections.Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())

    source = {i: s for i, _, s in rows}
    texts = {i: q for i, t, _ in rows if (q := quality(t)) is not None}
    name = components({i: grams(t, 5) for i, t in texts.items()}, 80, 100)
    texts = {i: t for i, t in texts.items() if name[i] == i}
    assert {41, 42, 43, 44, 45, 30, 40} & set(texts) == set() and {50, 51, 52, 53} <= set(texts)
    texts = redact(texts, source)
    assert own not in texts[50] and "Home" not in texts[50] and "<copied-secret>" in texts[51]
    plain = Tokenizer.from_file(queries.tokenizer_path())
    plain.no_truncation()
    plain.no_padding()
    want = collections.Counter()
    for i, n in copies(texts, source).items():
        ids = plain.encode(texts[i], add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        row = (i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(plain.decode(ids, skip_special_tokens=False).encode()))
        if n:
            want[row] = n
    assert got == want
