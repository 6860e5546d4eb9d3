"""Secret scans by grammar inference.

Labelled credentials of each format make a prefix tree.  States of one depth whose next characters
are statistically compatible (Hoeffding's bound on every class of characters and on stopping) are
merged, which folds the tree into a small probabilistic automaton.  Then states of neighbouring depths that go
on alike are merged too: such a run of one alphabet shares its characters' probabilities and may be left early or go on
beyond the longest sample (up to twice its length), by Laplace's rule, so lengths generalise.  In every document, every
run of characters that credentials are made of is looked at, whole and from and to each of its separators; what an
automaton accepts is scored: the log-likelihood under each format's automaton against that under a model of
ordinary runs, pairs of neighbouring characters counted in the documents themselves.  Of acceptances that overlap, the best
stays, or one that holds it whole and scores less by no more than the margin.

Runs so short that no string of their length reaches the margin under an automaton are passed over by it; that length is
computed from the automaton (``least``), so nothing that could be a finding is lost.
"""

from __future__ import annotations

import base64
import bisect
import json
import random
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import chunks, field, over_texts, raw_bytes, released, ship, texts_of

#: Nats by which a format must beat ordinary text, and nats a character.
MARGIN, MARGIN_EACH = 12.0, 0.5
#: Error probability of the compatibility test.
ALPHA = 0.01
SAMPLES = 400
#: Samples from which on a state that saw a single character is taken for fixed text, and one that saw no end for going on.
FEW = 64
#: Nats that leaving a run of one alphabet costs for each character between its length and that of a sample.
EARLY = np.log(64)

CANDIDATE = np.zeros(256, bool)
CANDIDATE[[ord(c) for c in string.ascii_letters + string.digits + "_-.+/="]] = True
#: Characters cut off both ends of a run: punctuation of the sentence around it.
TRIM = b"-.+/="
#: Characters that may join a credential to what is before or after it in a run.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[list(b"_-.+/=")] = True

_HEX, _UPPER36, _ALNUM = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
_URL64 = _ALNUM + "-_"


def labelled_credentials(seed: int = 11, each: int = SAMPLES) -> list[tuple[str, str]]:
    """(value, format): invented credentials of formats that their issuers document publicly."""
    rng = random.Random(seed)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))

    def b64(x: dict) -> str:
        return base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).decode().rstrip("=")

    def web_token() -> str:
        alg = rng.choice(["HS256", "HS384", "HS512", "RS256", "RS512", "ES256", "PS256"])
        word = lambda a, b: some(string.ascii_letters + "  ", rng.randint(a, b))
        head = {"alg": alg} | ({"typ": "JWT"} if rng.random() < 0.8 else {}) | ({"kid": some(_ALNUM, rng.randint(6, 20))} if rng.random() < 0.3 else {})
        now = rng.randint(10**9, 2 * 10**9)
        claims = {"sub": some(string.digits, rng.randint(1, 12)), "name": word(3, 16), "iss": "https://" + word(3, 12) + ".example", "admin": rng.random() < 0.5, "aud": word(3, 8), "iat": now, "exp": now + 3600, "jti": some(_HEX, 16)}
        claims = {k: v for k, v in claims.items() if rng.random() < 0.5} | {word(2, 8): word(1, 12) for _ in range(rng.randint(0, 2))} or {"sub": claims["sub"]}
        head, body = ({k: x[k] for k in rng.sample(sorted(x), len(x))} for x in (head, claims))
        return b64(head) + "." + b64(body) + "." + some(_URL64, {"2": 43, "3": 64, "5": 86}[alg[2]] if alg[0] == "H" else 86 if alg[0] == "E" else 342)

    make = {
        "cloud_access_key": lambda: rng.choice(["AKIA", "ASIA"]) + some(_UPPER36, 16),
        "cloud_secret_key": lambda: some(_ALNUM + "+/", 40),
        "code_host_token": lambda: rng.choice(["ghp_", "gho_", "ghs_", "ghu_"]) + some(_ALNUM, 36),
        "code_host_pat": lambda: "glpat-" + some(_URL64, rng.randint(20, 26)),
        "chat_token": lambda: rng.choice(["xoxb-", "xoxp-"]) + some(string.digits, rng.randint(10, 13)) + "-" + some(string.digits, rng.randint(10, 13)) + "-" + some(_ALNUM, 24),
        "maps_api_key": lambda: "AIza" + some(_URL64, 35),
        "payment_key": lambda: rng.choice(["sk_live_", "sk_test_", "rk_live_"]) + some(_ALNUM, rng.choice([24, 24, 34, 99])),
        "mail_key": lambda: "SG." + some(_URL64, 22) + "." + some(_URL64, 43),
        "package_token": lambda: "npm_" + some(_ALNUM, 36),
        "web_token": web_token,
        "hex_key": lambda: some(_HEX, 2 * rng.randint(8, 32)),
        "hex_32": lambda: some(_HEX, 32),
        "hex_40": lambda: some(_HEX, 40),
        "hex_64": lambda: some(_HEX, 64),
    }
    return [(f(), name) for name, f in make.items() for _ in range(each)]


def ordinary_runs(seed: int = 12) -> list[str]:
    """Runs that aren't credentials: long and hyphenated words, paths, host names, numbers, dates, versions."""
    rng = random.Random(seed)
    parts = "the and ing tion er st re on en th ou ea ble ly ed an or ti sch ung keit heit ver ge ment eau ción que ado mente oi aux elle".split()
    word = lambda a, b: "".join(c for _ in range(rng.randint(a, b)) for c in rng.choice(parts) if c.isascii())
    make = [
        lambda: word(5, 12), lambda: word(5, 12).capitalize(), lambda: word(5, 12).upper(), lambda: "-".join(word(1, 3) for _ in range(rng.randint(3, 6))), lambda: "/".join(word(1, 4) for _ in range(rng.randint(3, 6))),
        lambda: ".".join(word(1, 4) for _ in range(rng.randint(3, 5))), lambda: "_".join(word(1, 3) for _ in range(rng.randint(3, 6))), lambda: "".join(rng.choice(string.digits) for _ in range(rng.randint(16, 24))),
        lambda: "".join(word(1, 3).capitalize() for _ in range(rng.randint(3, 5))), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}_{word(2, 4)}.{word(1, 1)}", lambda: rng.choice("-_=.") * rng.randint(16, 60),
    ]
    return [x for _ in range(400) for f in make if len(x := f()) >= 16]


# character classes: digits, a-f, g-z, A-F, G-Z, then each other candidate character by itself
_CLASS = np.full(256, -1, np.int64)
for _c in range(256):
    if CANDIDATE[_c]:
        ch = chr(_c)
        _CLASS[_c] = 0 if ch.isdigit() else 1 if ch in "abcdef" else 2 if ch.islower() else 3 if ch in "ABCDEF" else 4 if ch.isupper() else 5 + "_-.+/=".index(ch)
CLASSES = 11
_CLASS_SIZE = np.array([10, 6, 20, 6, 20, 1, 1, 1, 1, 1, 1])


@dataclass
class Automaton:
    """Next state by state and character (-1: none), log-probability of the character, and of stopping, by state."""

    name: str
    next: np.ndarray
    logp: np.ndarray
    stop: np.ndarray
    least: int = 1  # no shorter string reaches the margins


def _compatible(a: np.ndarray, b: np.ndarray, alpha: float) -> bool:
    """Whether two states' counts (of classes, and last of stopping) may be of one distribution."""
    n, m = a.sum(), b.sum()
    bound = np.sqrt(0.5 * np.log(2 / alpha)) * (1 / np.sqrt(n) + 1 / np.sqrt(m))
    return bool((np.abs(a / n - b / m) < bound).all())


def infer(name: str, values: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of one format: its prefix tree, merged within layers, then across them (``_loops``).

    A state is the set of samples that reach it.  A child state joins the first state of its layer with
    compatible counts; when states join, so do their children by the same character (they are children of one
    state then).  A character that a state never saw gets what its class has left by Laplace's rule, if it saw the class
    often enough to be random; so does any other of the format's characters, unless the state is fixed text: it saw one character, ``FEW`` times at least.
    """
    data = [np.frombuffer(v.encode(), np.uint8) for v in values]
    shortest, longest = min((len(d) for d in data), default=0), max((len(d) for d in data), default=0)
    chars = np.full((len(data), longest + 1), -1, np.int64)
    for r, d in enumerate(data):
        chars[r, : len(d)] = d
    classes = np.where(chars >= 0, _CLASS[chars], CLASSES)
    layers: list[list[np.ndarray]] = [[np.arange(len(data))]]
    moves: list[list[dict[int, int]]] = []
    while True:
        depth = len(layers) - 1
        nxt: list[list[np.ndarray]] = []
        seen: list[np.ndarray] = []
        step: list[dict[int, int]] = []
        for rows in layers[depth]:
            at = chars[rows, depth]
            to = {}
            for ch, _ in sorted(zip(*map(np.ndarray.tolist, np.unique(at[at >= 0], return_counts=True))), key=lambda x: (-x[1], x[0])):
                kid = rows[at == ch]
                c = np.bincount(classes[kid, depth + 1], minlength=CLASSES + 1).astype(float)
                j = next((j for j, s in enumerate(seen) if _compatible(s, c, alpha)), None)
                if j is None:
                    nxt.append([]), seen.append(np.zeros(CLASSES + 1))
                    j = len(nxt) - 1
                nxt[j].append(kid)
                seen[j] = seen[j] + c
                to[ch] = j
            step.append(to)
        moves.append(step)
        if not nxt:
            break
        layers.append([np.concatenate(x) for x in nxt])
    first = np.concatenate([[0], np.cumsum([len(x) for x in layers])])
    states = int(first[-1])
    go, lp, stop = np.full((states, 256), -1, np.int32), np.full((states, 256), -np.inf), np.full(states, -np.inf)
    known = np.bincount(chars[chars >= 0], minlength=256) > 0
    count, random_ = np.zeros((states, 256)), np.zeros((states, CLASSES), bool)
    total = np.zeros(states)
    for t, layer in enumerate(layers):
        for i, rows in enumerate(layer):
            s = int(first[t]) + i
            n = total[s] = len(rows)
            at = chars[rows, t]
            count[s] = np.bincount(at[at >= 0], minlength=256)
            if (at < 0).any():
                stop[s] = np.log((at < 0).mean())
            for cl in range(CLASSES):
                mine = np.flatnonzero((_CLASS == cl) & (count[s] > 0))
                if not len(mine):
                    continue
                free, many = int(_CLASS_SIZE[cl]), count[s, mine].sum()
                random_[s, cl] = len(mine) > 1 and len(mine) >= min(free, 4) and many >= 8
                flow: dict[int, float] = {}
                for ch in mine.tolist():
                    go[s, ch] = first[t + 1] + moves[t][i][ch]
                    flow[int(go[s, ch])] = flow.get(int(go[s, ch]), 0) + count[s, ch]
                    lp[s, ch] = np.log((count[s, ch] + 0.5) / (n + 0.5 * free) if random_[s, cl] else count[s, ch] / n)
                if random_[s, cl]:
                    rest = np.flatnonzero((_CLASS == cl) & (count[s] == 0))
                    go[s, rest] = max(flow, key=flow.get)
                    lp[s, rest] = np.log(0.5 / (n + 0.5 * free))
            on = np.flatnonzero(count[s])
            rest = np.flatnonzero(known & (go[s] < 0))
            if len(on) > 1 or 0 < count[s].sum() < FEW:  # not fixed text: what the format has elsewhere may come here too
                go[s, rest] = int(np.bincount(go[s, on], weights=count[s, on]).argmax())
                lp[s] += np.log(n / (n + 0.5 * len(rest)))
                lp[s, rest] = np.log(0.5 / (n + 0.5 * len(rest)))
            if n < FEW and np.isinf(stop[s]):
                stop[s] = np.log(0.5 / (n + 1)) - EARLY * max(0, shortest - t)
    return _loops(Automaton(name, go, lp, stop), count, random_, total, alpha)


def _loops(a: Automaton, count: np.ndarray, random_: np.ndarray, total: np.ndarray, alpha: float) -> Automaton:
    """Merges states across depths: a chain of states that go on alike becomes one state with a counter.

    Its states share the probabilities of the alphabet's characters.  Where no sample leaves the chain, it may be left
    as at the nearest place where one does, at Laplace's probability and ``EARLY`` for each character between; after the last one
    has left, it may go on for as many characters again, at Laplace's probability of half a sample.
    """
    taken = np.zeros(len(total), bool)
    more: list[tuple[np.ndarray, np.ndarray, float]] = []
    base = len(total)
    go, lp, stop = a.next.copy(), a.logp.copy(), a.stop.copy()

    def onward(s: int, alphabet: np.ndarray) -> int:
        """The state that most of the alphabet's characters lead to; -1 if hardly any."""
        on = np.bincount(a.next[s, alphabet & (count[s] > 0)], weights=count[s, alphabet & (count[s] > 0)]) if (alphabet & (count[s] > 0)).any() else np.zeros(0)
        return int(on.argmax()) if len(on) and on.max() >= 0.9 * on.sum() and on.sum() >= 8 else -1

    for s in range(len(total)):
        if taken[s] or not random_[s].any():
            continue
        alphabet = np.zeros(256, bool)
        alphabet[_CLASS >= 0] = random_[s][_CLASS[_CLASS >= 0]]
        within = lambda u: np.bincount(_CLASS[alphabet], weights=count[u, alphabet], minlength=CLASSES)  # noqa: B023, E731
        chain, u = [s], onward(s, alphabet)
        while u >= 0 and not taken[u] and within(u).sum() >= 8 and _compatible(sum(within(c) for c in chain), within(u), alpha):
            chain.append(u)
            u = onward(u, alphabet)
        if len(chain) < 3:
            continue
        taken[chain] = True
        nexts = [*chain[1:], u]
        inner = sum(count[c] * (a.next[c] == v) for c, v in zip(chain, nexts) if v >= 0)
        alphabet |= (inner >= 8) & (inner >= 0.9 * count[chain].sum(axis=0))  # single characters that stay in the chain
        pooled = count[chain].sum(axis=0) * alphabet + 0.5 * alphabet
        shared = np.full(256, -np.inf)
        shared[alphabet] = np.log(pooled[alphabet] / pooled.sum())
        for c, v in zip(chain, nexts):
            mass = np.log(np.exp(a.logp[c, alphabet]).sum())
            go[c, alphabet & (go[c] < 0)] = v if v >= 0 else -1
            on = alphabet & (go[c] >= 0)
            lp[c, on] = shared[on] + mass
        ends = [*chain, u] if u >= 0 else chain
        for i, c in enumerate(chain[1:], 1):
            extra = np.log(0.5 / (total[c] + 1))
            for j in sorted(range(len(ends)), key=lambda j: abs(j - i)):
                new = ~alphabet & (a.next[ends[j]] >= 0) & (go[c] < 0)
                go[c, new], lp[c, new] = a.next[ends[j], new], extra - EARLY * abs(j - i) + a.logp[ends[j], new]
                if np.isinf(stop[c]) and np.isfinite(a.stop[ends[j]]):
                    stop[c] = extra - EARLY * abs(j - i) + a.stop[ends[j]]
        if u >= 0 and not (alphabet & (count[u] > 0)).any():
            stay = np.log(0.5 / (total[u] + 1))
            first = base + len(more)
            for i in range(len(chain)):
                row, logp = a.next[u].copy(), a.logp[u] + np.log(0.5)
                if i < len(chain) - 1:
                    row[alphabet], logp[alphabet] = first + i + 1, shared[alphabet] + np.log(0.5)
                more.append((row, logp, a.stop[u] + np.log(0.5)))
            leave = np.log((total[u] + 0.5) / (total[u] + 1))
            lp[u] += leave
            stop[u] += leave
            go[u, alphabet], lp[u, alphabet] = first, shared[alphabet] + stay
    if more:
        go, lp, stop = np.concatenate([go, [m[0] for m in more]]).astype(np.int32), np.concatenate([lp, [m[1] for m in more]]), np.concatenate([stop, [m[2] for m in more]])
    return Automaton(a.name, go, lp, stop)


@dataclass
class Grammar:
    automata: list[Automaton]
    pair: np.ndarray  # ordinary runs: log-probability of a character by the one before (0: none)

    @property
    def least(self) -> int:
        return min((a.least for a in self.automata), default=1)

    def shortest(self, a: Automaton, most: int = 64) -> int:
        """The least length of a string that reaches the margins with an automaton, up to ``most``: the best string of every length, state and last character."""
        front = {0: np.where(np.arange(256) == 0, 0.0, -np.inf)}  # of each state, the best score by last character
        for t in range(1, most):
            nxt: dict[int, np.ndarray] = {}
            for s, v in front.items():
                live = np.flatnonzero(np.isfinite(v))
                gain = (v[live, None] - self.pair[live]).max(axis=0) + a.logp[s]
                for u in np.unique(a.next[s][a.next[s] >= 0]).tolist():
                    here = np.where(a.next[s] == u, gain, -np.inf)
                    nxt[u] = np.maximum(nxt[u], here) if u in nxt else here
            front = nxt
            if any(v.max() + a.stop[s] >= max(MARGIN, MARGIN_EACH * t) for s, v in front.items()):
                return t
        return most

    def accepted(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, each pair once, of every span that an automaton accepts, ends at a run's end or before a separator,
        and begins at a run's start or after a separator; ``start``, ``end``: the runs."""
        mark = np.zeros(len(buf) + 1, np.int64)
        mark[start] += 1
        mark[end] -= 1
        inside = np.flatnonzero(SEPARATOR[buf] & (np.cumsum(mark[:-1]) > 0)) + 1
        begin = np.union1d(start, inside)
        stop = end[np.searchsorted(start, begin, side="right") - 1]  # of the run
        long = stop - begin >= self.least
        begin, stop = begin[long], stop[long]
        found: list[np.ndarray] = []
        room = stop - begin
        for a in self.automata:
            live = np.flatnonzero((room >= a.least) & (a.next[0, buf[np.minimum(begin, len(buf) - 1)]] >= 0))
            state, t = np.zeros(len(live), np.int64), 0
            while len(live):
                at = begin[live] + t
                over = at == stop[live]
                ends = (over | SEPARATOR[buf[np.minimum(at, len(buf) - 1)]]) & np.isfinite(a.stop[state])
                if t >= a.least and ends.any():
                    found.append(np.stack([begin[live[ends]], at[ends]], 1))
                live, state, at = live[~over], state[~over], at[~over]
                state = a.next[state, buf[at]].astype(np.int64)
                live, state = live[state >= 0], state[state >= 0]
                t += 1
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return both[:, 0], both[:, 1]

    def score(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each span: the best format (-1: no automaton accepts it) and its log-likelihood over ordinary text's."""
        n = len(start)
        best, score = np.full(n, -1, np.int64), np.full(n, -np.inf)
        if not n:
            return best, score
        length = end - start
        total = np.cumsum(length)
        at = np.arange(total[-1]) - np.repeat(total - length, length) + np.repeat(start, length)
        before = buf[at - 1].copy()
        before[total - length] = 0
        plain = np.add.reduceat(self.pair[before, buf[at]], total - length)
        for f, a in enumerate(self.automata):
            live = np.arange(n)
            state, ll = np.zeros(len(live), np.int64), np.zeros(len(live))
            t = 0
            while len(live):
                over = length[live] == t
                if over.any():
                    done = live[over]
                    s = ll[over] + a.stop[state[over]] - plain[done]
                    win = s > score[done]
                    score[done[win]], best[done[win]] = s[win], f
                    live, state, ll = live[~over], state[~over], ll[~over]
                    if not len(live):
                        break
                c = buf[start[live] + t]
                ll = ll + a.logp[state, c]
                state = a.next[state, c]
                ok = state >= 0
                live, state, ll = live[ok], state[ok].astype(np.int64), ll[ok]
                t += 1
        best[~np.isfinite(score)] = -1
        return best, score


def fit(credentials: list[tuple[str, str]] | None = None, ordinary: list[str] | None = None, alpha: float = ALPHA, pairs: np.ndarray | None = None) -> Grammar:
    """Automata from labelled credentials (value, format), and the model of ordinary runs, of which ``pairs`` (``document_pairs``) were counted besides."""
    credentials = labelled_credentials() if credentials is None else credentials
    ordinary = ordinary_runs() if ordinary is None else ordinary
    by: dict[str, list[str]] = {}
    for value, name in credentials:
        by.setdefault(name, []).append(value)
    count = np.full((256, 256), 0.5) + (0 if pairs is None else pairs)
    for x in ordinary:
        b = np.frombuffer(("\0" + x).encode(), np.uint8)
        np.add.at(count, (b[:-1], b[1:]), 1)
    total = count[:, CANDIDATE].sum(axis=1, keepdims=True)
    made = Grammar([infer(n, v, alpha) for n, v in sorted(by.items())], np.log(count / total))
    for a in made.automata:
        a.least = made.shortest(a)
    return made


def pairs_of(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often each character follows each other one in the runs of a batch; 0: a run's start."""
    start, end = runs(buf, off, 1)
    out = np.zeros(1 << 16, np.int64)
    if not len(start):
        return out
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
    before = np.concatenate([[0], buf[:-1]]).astype(np.int64)
    before[start] = 0
    return np.bincount((before << 8 | buf)[inside], minlength=1 << 16)


def document_pairs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """256 x 256 counts of neighbouring characters in the runs of all documents; zeros for an empty table."""
    ship(docs.sparkSession)

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for i, j in chunks(batch.column(0)):
                total += pairs_of(*raw_bytes(batch.column(0).slice(i, j - i), lower=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])
        released()

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # a few thousand pairs at most
    out = np.zeros(1 << 16)
    out[[r["pair"] for r in got]] = [r["n"] for r in got]
    return out.reshape(256, 256)


def runs(buf: np.ndarray, off: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of at least ``least`` candidate characters."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = CANDIDATE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    # in `name=value`, a single equals sign that isn't at the end is between two runs
    eq = buf == ord("=")
    sep = eq.copy()
    sep[:-1] &= ok[1:] & ~eq[1:]
    sep[-1:] = False
    sep[1:] &= ~eq[:-1]
    ok = ok & ~sep
    begin, stop = ok.copy(), ok.copy()
    begin[1:] &= ~ok[:-1] | cut[1:-1]
    stop[:-1] &= ~ok[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = end - start >= least
    return start[long], end[long]


def candidates(buf: np.ndarray, off: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of candidate characters, ends trimmed, of at least ``least`` of them."""
    start, end = runs(buf, off, least)
    if not len(start):
        return start, end, start
    trim = np.zeros(256, bool)
    trim[list(TRIM)] = True
    while True:
        m = (start < end) & trim[buf[np.minimum(start, len(buf) - 1)]]
        if not m.any():
            break
        start = start + m
    pad = trim.copy()
    pad[ord("=")] = False  # base64 may end in it
    while True:
        m = (start < end) & pad[buf[end - 1]]
        if not m.any():
            break
        end = end - m
    long = end - start >= least
    start, end = start[long], end[long]
    return start, end, np.searchsorted(off, start, side="right") - 1


def findings(grammar: Grammar, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """row, start and end (bytes in the row's text), format, score of every secret in a batch, in order."""
    buf, off = raw_bytes(texts, lower=False)
    start, end = grammar.accepted(buf, *runs(buf, off, grammar.least))
    best, score = grammar.score(buf, start, end)
    hit = np.flatnonzero((best >= 0) & (score >= MARGIN) & (score >= MARGIN_EACH * (end - start)))
    kept: list[int] = []
    begins: list[int] = []  # of the kept, ascending
    upto: dict[int, int] = {}
    for k in hit[np.lexsort((start[hit], -score[hit]))].tolist():  # the best first
        near = hit[(start[hit] <= start[k]) & (end[hit] >= end[k]) & (score[hit] >= score[k] - MARGIN)]
        k = int(near[np.argmax(end[near] - start[near])])  # or what holds it whole and is hardly worse
        s, e = int(start[k]), int(end[k])
        i = bisect.bisect_right(begins, s)
        if (i == 0 or upto[begins[i - 1]] <= s) and (i == len(begins) or begins[i] >= e):
            begins.insert(i, s)
            upto[s] = e
            kept.append(k)
    at = np.sort(np.array(kept, np.int64))
    start, end = start[at], end[at]
    row = np.searchsorted(off, start, side="right") - 1
    return row, start - off[row], end - off[row], best[at], score[at]


def scan(docs: DataFrame, grammar: Grammar | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per secret: id, start and length (characters, from 0), format, score.

    Null and empty texts have none, nor has an empty table.  Repeated rows report theirs each.  If two formats score the same,
    the first by name is named.  Candidates that no automaton accepts, or that beat ordinary text
    by less than the margins, are no secrets.  The secret itself isn't reported.  Very long texts are scanned whole.
    Other columns are ignored.  Without a grammar, one is fitted with the pairs of characters of these documents.
    """
    spark = docs.sparkSession
    ship(spark)
    spread = spark.sparkContext.broadcast(grammar or fit(pairs=document_pairs(docs, text_col)))  # automata of the known formats
    schema = T.StructType([field(docs, id_col), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("format", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        row, start, end, fmt, score = findings(spread.value, texts)
        names = [a.name for a in spread.value.automata]
        chars = [len(texts[int(r)].as_py().encode()[: int(s)].decode()) for r, s in zip(row, start)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(chars, pa.int64()), pa.array((end - start).astype(np.int64)), pa.array([names[f] for f in fmt], pa.string()), pa.array(np.round(score, 6))], names=schema.names)

    return texts_of(docs, id_col, text_col).mapInArrow(over_texts(work), schema)


def redact(docs: DataFrame, grammar: Grammar | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by [SECRET:format]; all else as it is.

    Null and empty texts stay what they are, repeated rows are changed alike, an empty table stays empty, columns of
    any name pass through.  The secrets, and the grammar, are those of ``scan``.
    """
    spark = docs.sparkSession
    ship(spark)
    spread = spark.sparkContext.broadcast(grammar or fit(pairs=document_pairs(docs, text_col)))

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out: list[pa.Array] = []
        for i, j in chunks(texts):
            part = texts.slice(i, j - i)
            row, start, end, fmt, _ = findings(spread.value, part)
            if not len(row):
                out.append(part.cast(pa.string()))
                continue
            vals = part.to_pylist()
            names = [a.name for a in spread.value.automata]
            for r in np.unique(row):
                raw, at, new = vals[r].encode(), 0, []
                for k in np.flatnonzero(row == r):
                    new += [raw[at : start[k]], f"[SECRET:{names[fmt[k]]}]".encode()]
                    at = int(end[k])
                vals[r] = b"".join([*new, raw[at:]]).decode()
            out.append(pa.array(vals, pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fourth stage of the corpus pipeline: all documents, their secrets redacted and n_chars, if there is such a column, counted again."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)
