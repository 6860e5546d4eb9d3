"""op3: automata scored one character at a time in plain Python, and credentials planted in prose."""

from __future__ import annotations

import base64
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import fixtures as fx
from weftline.llm import queries
from weftline.llm import secretscan as ss


@pytest.fixture(scope="module")
def grammar():
    return ss.fit()


def slow_score(g: ss.Grammar, run: str) -> tuple[str | None, float]:
    raw = run.encode()
    plain = sum(float(g.pair[a, b]) for a, b in zip(b"\0" + raw[:-1], raw))
    best, top = None, -math.inf
    for a in g.automata:
        state, ll = 0, 0.0
        for c in raw:
            ll += float(a.logp[state, c])
            state = int(a.next[state, c])
            if state < 0:
                break
        else:
            ll += float(a.stop[state])
            if ll - plain > top:
                best, top = a.name, ll - plain
    return best, top


def slow_candidates(text: str, least: int) -> list[tuple[int, int]]:
    out = []
    for m in re.finditer(r"[A-Za-z0-9_\-.+/=]+", text):
        # a lone equals sign between characters separates
        at = m.start()
        for piece in re.split(r"(?<!=)=(?=[A-Za-z0-9_\-.+/])", m.group()):
            lead = len(piece) - len(piece.lstrip("-.+/="))
            body = piece[lead:].rstrip("-.+/")
            if len(piece) >= least and len(body) >= least:
                out.append((at + lead, at + lead + len(body)))
            at += len(piece) + 1
    return out


def test_scores_and_candidates_equal_plain_python(grammar):
    held_out = ss.labelled_credentials(seed=99, each=6)
    texts = [f"user said key={v}, then left. See docs/{i}/some_longer_path-name.html ({n}) x={v}." for i, (v, n) in enumerate(held_out)] + ["", None, "a=b==c " + "Z" * 40 + "==", "===== ------------------------ ....", "é" * 30 + "AKIA" + "Q" * 16]
    arr = pa.array(texts, pa.string())
    buf, off = ss.raw_bytes(arr, lower=False)
    start, end, row = ss.candidates(buf, off, 5)
    got = [(int(r), int(s - off[r]), int(e - off[r])) for r, s, e in zip(row, start, end)]
    want = [(i, len(t[:a].encode()), len(t[:b].encode())) for i, t in enumerate(texts) if t for a, b in slow_candidates(t, 5)]
    assert got == want
    best, score = grammar.score(buf, start, end)
    for k in range(len(start)):
        name, s = slow_score(grammar, buf[start[k] : end[k]].tobytes().decode())
        assert (grammar.automata[best[k]].name if best[k] >= 0 else None) == name
        assert name is None or score[k] == pytest.approx(s, abs=1e-6)


def test_held_out_credentials_are_found_and_prose_is_not(grammar):
    secrets = ss.labelled_credentials(seed=77, each=50)
    row, _, _, fmt, _ = ss.findings(grammar, pa.array([f"token: {v}\n" for v, _ in secrets]))
    found = {int(r): grammar.automata[f].name for r, f in zip(row, fmt)}
    assert len(found) / len(secrets) > 0.97
    assert sum(found[i] == n for i, (_, n) in enumerate(secrets) if i in found) / len(found) > 0.97
    plain = ss.ordinary_runs(seed=55)
    assert len(ss.findings(grammar, pa.array(plain))[0]) / len(plain) < 0.01


def test_edges_and_joined_credentials(grammar):
    """Values whose own ends are separators, and values joined to other run characters, are found whole."""
    secrets = [(v, n) for v, n in ss.labelled_credentials(seed=21, each=400) if v[0] in "-.+/=_" or v[-1] in "-.+/=_"]
    assert len(secrets) > 20
    text = [f"token: {v}\n" for v, _ in secrets]
    row, start, end, _, _ = ss.findings(grammar, pa.array(text))
    whole = {int(r) for r, s, e in zip(row, start, end) if text[r][s:e] == secrets[r][0]}
    assert len(whole) / len(secrets) > 0.95
    fixed = [(v, n) for v, n in ss.labelled_credentials(seed=22, each=5) if n in ("code_host_token", "cloud_access_key", "package_token", "payment_key", "hex_64")]
    for before, after in (("https://host.example/path/", ""), ("build-", "-linux"), ("my_", ".txt"), ("a/", "/b/c"), ("==", "==")):
        text = [f"see {before}{v}{after} there" for v, _ in fixed]
        row, start, end, fmt, _ = ss.findings(grammar, pa.array(text))
        assert [(text[r][s:e], grammar.automata[f].name) for r, s, e, f in zip(row, start, end, fmt)] == fixed
    two = "/".join(v for v, n in fixed if n == "code_host_token")
    row, start, end, _, _ = ss.findings(grammar, pa.array([two]))
    assert "/".join(two[s:e] for s, e in zip(start, end)) == two and len(row) == 5


def test_states_merge():
    values = ["AB" + str(i).zfill(6) for i in range(0, 999_999, 2501)]
    a = ss.infer("t", values)
    # fixed letters, six digit states that share their probabilities, the end, and as many digits again
    assert len(a.stop) == 9 + 6
    state, states = 0, []
    for c in b"AB123456":
        states.append(state)
        state = int(a.next[state, c])
    assert np.allclose(a.logp[states[2:], 48:58], a.logp[states[2], 48:58])
    assert a.logp[states[0], 65] == 0 and a.next[states[0], 66] == -1
    assert ss.fit([("AB" + str(i).zfill(16), "t") for i in range(300)], ["someordinaryword"]).automata[0].name == "t"


def test_lengths_generalise(grammar):
    """Variants of known formats that no sample has: other lengths, another algorithm, another claim."""
    rng = random.Random(6)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = lambda x: base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).decode().rstrip("=")
    sign = lambda head, body: f"{b64(head)}.{b64(body)}.{some(ss._URL64, 43)}"
    for _ in range(20):
        want = [
            ("web_token", sign({"alg": "RS256", "typ": "JWT"}, {"sub": "1234567890", "iat": 1516239022})), ("web_token", sign({"alg": "HS256", "typ": "JWT"}, {"sub": "1234567890", "name": "John Doe", "iat": 1516239022})),
            ("code_host_pat", "glpat-" + some(ss._URL64.rstrip("-"), 25)), ("code_host_pat", "glpat-" + some(ss._URL64.rstrip("-"), 30)), ("payment_key", "sk_live_" + some(ss._ALNUM, 40)),
            ("chat_token", f"xoxb-{some('0123456789', 11)}-{some('0123456789', 12)}-{some(ss._ALNUM, 24)}"), ("code_host_token", "ghp_" + some(ss._ALNUM, 40)), ("package_token", "npm_" + some(ss._ALNUM, 33)),
        ]
        text = [f"use {v} here" for _, v in want]
        row, start, end, fmt, _ = ss.findings(grammar, pa.array(text))
        assert [(grammar.automata[f].name, text[r][s:e]) for r, s, e, f in zip(row, start, end, fmt)] == want


def test_short_and_ordinary_runs_are_left_alone(grammar):
    plain = ["a3f9c2b", "3f2504e04f89", "X9-Q7", "AKIA7Q", "4111111111111111", "123e4567-e89b-12d3-a456-426614174000", "https://example.com/some/path-to_file.html", "eyJh", "sk_live_", "0" * 40]
    assert len(ss.findings(grammar, pa.array([f"see {x} there" for x in plain]))[0]) == 0


def test_no_shorter_string_reaches_the_margin(grammar):
    """``least`` against all strings of that length less one: the greatest score of each automaton's paths, character by character."""
    assert grammar.least == min(a.least for a in grammar.automata) > 1
    for a in grammar.automata:
        n = min(a.least - 1, 16)
        best: dict[tuple[int, int], float] = {(0, 0): 0.0}
        for _ in range(n):
            nxt: dict[tuple[int, int], float] = {}
            for (s, c), v in best.items():
                for d in np.flatnonzero(a.next[s] >= 0).tolist():
                    key, w = (int(a.next[s, d]), d), v + float(a.logp[s, d] - grammar.pair[c, d])
                    nxt[key] = max(nxt.get(key, -math.inf), w)
            best = nxt
        assert max((v + float(a.stop[s]) for (s, _), v in best.items()), default=-math.inf) < ss.MARGIN


def test_ordinary_runs_are_counted_in_all_documents(spark):
    texts = ["ab ab-c", None, "", "x=y", "ab " * 100_000]
    got = ss.document_pairs(fx.docs(spark, *texts))
    want = np.zeros((256, 256))
    for t in texts:
        for run in re.findall(r"[A-Za-z0-9_\-.+/]+", t or ""):
            for a, b in zip(b"\0" + run.encode(), run.encode()):
                want[a, b] += 1
    assert (got == want).all()


def test_registered_query_equals_one_pass_in_plain_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    g = ss.fit(pairs=ss.document_pairs(docs))
    want = []
    for r in docs.select("doc_id", "text").collect():
        for _, s, e, f, _ in zip(*ss.findings(g, pa.array([r["text"]]))):
            want.append((r["doc_id"], len((r["text"] or "").encode()[:s].decode()), int(e - s), g.automata[f].name))
    got = [(r["doc_id"], r["start"], r["length"], r["format"]) for r in queries.op3_secret_scan(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(want) and len(got) > 5


def test_scan_and_redact(spark, grammar):
    v, name = next((v, n) for v, n in ss.labelled_credentials(seed=3, each=1) if n == "code_host_token")
    df = fx.awkward(spark).unionByName(fx.docs(spark, f"é key={v} end", f"{v}", first=50)).unionByName(fx.docs(spark, f"{v}", first=51))
    got = ss.scan(df, grammar).where("doc_id >= 50").collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["format"]) for r in got) == [(50, 6, 40, name), (51, 0, 40, name), (51, 0, 40, name)]
    clean = ss.redact(df, grammar)
    assert clean.columns == df.columns and clean.count() == df.count()
    by = {r["doc_id"]: r["text"] for r in clean.where("doc_id >= 50").collect()}
    assert by == {50: f"é key=[SECRET:{name}] end", 51: f"[SECRET:{name}]"}
    before, after = (sorted((r["doc_id"], r["text"]) for r in d.where("doc_id < 6").select("doc_id", "text").where("text is not null").collect()) for d in (df, clean))
    assert before == after
    assert ss.scan(fx.empty(spark), grammar).count() == 0
    assert np.isfinite([r["score"] for r in got]).all()
