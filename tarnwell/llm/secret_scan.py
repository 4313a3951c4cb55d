"""Secret scans: a character convolutional network over every candidate and its context.

Candidates are runs of characters that keys are made of: of at least `least` characters with a digit, or assigned
(after `=` or `:`, whatever quotes and blanks are between) and of at least `least_assigned`, with or without a digit;
and every line between the heading of a private key and its end. Every candidate of a text is scored, with the
characters before and after it, by a network in NumPy: character embedding and place, convolution, maxima over context
before, candidate and context after, logistic layer. A candidate that is longer than the network's view is scored
piece by piece, from end to end, and has the score of its best piece. The network is trained here, on labelled
findings in their texts: secrets of many formats and what looks like them but isn't (hashes in check sums, UUIDs,
numbers, paths, addresses, placeholders, words after a colon, identifiers). Scores are calibrated on findings held out
(Platt scaling), and the threshold of each kind of candidate is the highest that still finds `recall` of the held-out
secrets of that kind.

Defined results: null and empty texts have no findings; a null doc_id stays null in them; each input row is scanned
by itself, repeated rows alike; places count characters from 0; texts and candidates of any length are scanned whole;
an empty table gives an empty result; other columns are not looked at, and redaction leaves them as they were (but
n_chars, which follows the text).
"""

from __future__ import annotations

import base64
import functools
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class ScanConfig:
    """examples: texts with a labelled finding each that the network is trained on (half as many again for calibration); inside: characters of a candidate that the network sees at once."""

    least: int = 16
    least_assigned: int = 8
    before: int = 32
    inside: int = 56
    after: int = 12
    width: int = 5
    filters: int = 24
    embedding: int = 8
    examples: int = 9000
    epochs: int = 8
    recall: float = 0.998
    seed: int = 23

    @property
    def length(self) -> int:
        return self.before + self.inside + self.after


KINDS = ("assigned", "bare", "private key")
_ASSIGNED_KIND, _BARE_KIND, _BLOCK_KIND = range(3)
_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in string.ascii_letters + string.digits + "+/_-.=~"]] = True
_ASSIGNED = np.zeros(256, bool)
_ASSIGNED[[*map(ord, string.ascii_letters + string.digits + "+/_-.=~@!%^&*$"), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_QUOTE = np.isin(np.arange(256), [32, 34, 39, 96, 9])
_HEADING = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_LINE = re.compile(rb"\\[nr]|((?:(?!\\[nr])[^\r\n\"'])+)")  # a line may end with a written \\n as well


def key_lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the lines between the heading of a private key and its end, or that of the text."""
    lo, hi = int(off[0]), int(off[-1])
    x, out = buf[lo:hi].tobytes(), []
    for m in _HEADING.finditer(x):
        end = int(off[np.searchsorted(off[1:], m.start() + lo, "right") + 1]) - lo
        if m.end() <= end:
            stop = x.find(b"-----", m.end(), end)
            for line in _LINE.finditer(x, m.end(), end if stop < 0 else stop):
                if inner := (line[1] or b"").strip():
                    a = line.start() + line[1].index(inner)
                    out.append((a + lo, a + len(inner) + lo))
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def candidates(buf: np.ndarray, off: np.ndarray, cfg: ScanConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of the candidates, in bytes of buf, in order and apart from each other."""
    lo, hi = int(off[0]), int(off[-1])
    if hi <= lo:
        z = np.zeros(0, np.int64)
        return z, z, z
    x = buf[lo:hi]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[x], dtype=np.int32)])
    signs = np.concatenate([[0], np.cumsum(_ASSIGNED[x] & ~_KEY[x], dtype=np.int32)])
    equals = np.concatenate([[0], np.cumsum(x == 61, dtype=np.int32)])
    visible = np.maximum.accumulate(np.where(_QUOTE[x], np.int32(-1), np.arange(hi - lo, dtype=np.int32)))  # the last byte up to here that is no quote or blank

    def runs(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, whether it is assigned); of key=value in one run the value."""
        s, e = C.spans(buf, off, table)
        long = np.flatnonzero(e - s >= cfg.least_assigned)
        s, e = s[long], e[long]
        given = np.zeros(len(s), bool)
        for i in np.flatnonzero(equals[e - lo] - equals[s - lo] > 0):
            piece = buf[s[i] : e[i]].tobytes().rstrip(b"=")
            lead = piece.rfind(b"=") + 1
            if lead and len(piece) - lead >= cfg.least_assigned:
                s[i] += lead
                given[i] = True
        first = off[np.searchsorted(off[1:], s, "right")] - lo
        at = np.where(s - lo > first, visible[np.maximum(s - lo - 1, 0)], -1)
        return s, e, given | ((at >= first) & np.isin(x[np.maximum(at, 0)], [61, 58]))

    s, e, given = runs(_KEY)
    ok = ((digits[e - lo] - digits[s - lo] > 0) & (e - s >= cfg.least)) | given
    s, e, kind = s[ok], e[ok], np.where(given[ok], _ASSIGNED_KIND, _BARE_KIND)
    ps, pe, given = runs(_ASSIGNED)  # passwords hold other signs as well
    ok = given & (signs[pe - lo] - signs[ps - lo] > 0)
    for a, b, k in ((ps[ok], pe[ok], _ASSIGNED_KIND), (*key_lines(buf, off), _BLOCK_KIND)):
        if len(a):  # the wider candidate stands for those that it touches
            inside = np.searchsorted(a, e, "left") - 1
            free = (inside < 0) | (b[np.maximum(inside, 0)] <= s)
            s, e, kind = np.concatenate([s[free], a]), np.concatenate([e[free], b]), np.concatenate([kind[free], np.full(len(a), k)])
            o = np.argsort(s, kind="stable")
            s, e, kind = s[o], e[o], kind[o]
    return s, e, kind


def windows(buf: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, cfg: ScanConfig) -> tuple[np.ndarray, np.ndarray]:
    """(bytes around each piece of the candidates, 0 beyond its text; number of the first piece of each candidate)."""
    pieces = np.maximum(-(-(e - s) // cfg.inside), 1)
    of = np.repeat(np.arange(len(s)), pieces)
    a = np.minimum(s[of] + cfg.inside * C.expand(np.zeros(len(s), np.int64), pieces), np.maximum(s, e - cfg.inside)[of])
    b = np.minimum(a + cfg.inside, e[of])
    d = np.searchsorted(off[1:], a, "right")
    first, last = off[d], off[d + 1]
    out = np.zeros((len(a), cfg.length), np.uint8)

    def put(at: int, start: np.ndarray, n: int, lo: np.ndarray, hi: np.ndarray) -> None:
        for k in range(n):
            p = start + k
            ok = (p >= lo) & (p < hi)
            out[ok, at + k] = buf[p[ok]]

    put(0, a - cfg.before, cfg.before, first, a)
    put(cfg.before, a, cfg.inside, a, b)
    put(cfg.before + cfg.inside, b, cfg.after, b, last)
    return out, np.cumsum(pieces) - pieces


class Network:
    """Embedding, convolution, maxima over three regions, logistic layer; gradients by hand, Adam."""

    def __init__(self, cfg: ScanConfig) -> None:
        rng = np.random.default_rng(cfg.seed)
        k = cfg.width * (cfg.embedding + 1)
        self.cfg = cfg
        self.w = {"emb": rng.normal(0, 0.5, (256, cfg.embedding)), "conv": rng.normal(0, (2 / k) ** 0.5, (k, cfg.filters)), "bias": np.zeros(cfg.filters), "out": rng.normal(0, 0.1, 3 * cfg.filters), "b": np.zeros(1)}
        self.w = {n: v.astype(np.float32) for n, v in self.w.items()}
        self.mark = np.zeros(cfg.length, np.float32)
        self.mark[cfg.before : cfg.before + cfg.inside] = 1
        n, a, b = cfg.length - cfg.width + 1, cfg.before - cfg.width // 2, cfg.before + cfg.inside - cfg.width // 2
        self.regions = ((0, a), (a, b), (b, n))

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.w["emb"][x]
        e = np.concatenate([e, np.broadcast_to(self.mark[None, :, None], (*x.shape, 1))], 2).astype(np.float32)
        n = x.shape[1] - self.cfg.width + 1
        return np.concatenate([e[:, i : i + n] for i in range(self.cfg.width)], 2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        out = [self._forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]
        return np.concatenate(out).astype(float) if out else np.zeros(0)

    def _forward(self, x: np.ndarray) -> tuple:
        cols = self._columns(x)
        h = cols @ self.w["conv"] + self.w["bias"]
        at = [h[:, a:b].argmax(1) + a for a, b in self.regions]
        top = [np.take_along_axis(h, i[:, None, :], 1)[:, 0] for i in at]
        f = np.maximum(np.concatenate(top, 1), 0)
        return f @ self.w["out"] + self.w["b"][0], f, at, cols

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        cfg, rng = self.cfg, np.random.default_rng(self.cfg.seed + 1)
        m = {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in self.w.items()}
        step, steps = 0, cfg.epochs * -(-len(x) // 64)
        for _ in range(cfg.epochs):
            for i in np.array_split(rng.permutation(len(x)), -(-len(x) // 64)):
                z, f, at, cols = self._forward(x[i])
                dz = ((1 / (1 + np.exp(-z)) - y[i]) / len(i)).astype(np.float32)
                df = dz[:, None] * self.w["out"][None] * (f > 0)
                g = {"out": f.T @ dz, "b": np.array([dz.sum()]), "bias": np.zeros(cfg.filters, np.float32), "conv": np.zeros_like(self.w["conv"])}
                places, parts = [], []
                row = np.arange(len(i))[:, None]
                for r, p in enumerate(at):  # p: place of each filter's maximum
                    d = df[:, r * cfg.filters : (r + 1) * cfg.filters]
                    g["bias"] += d.sum(0)
                    g["conv"] += np.einsum("nfk,nf->kf", cols[row, p], d)
                    back = d[:, :, None] * self.w["conv"].T[None]
                    for t in range(cfg.width):
                        part = back[:, :, t * (cfg.embedding + 1) : t * (cfg.embedding + 1) + cfg.embedding]
                        places.append(x[i][row, p + t].ravel())
                        parts.append(part.reshape(-1, cfg.embedding))
                at_byte, flow = np.concatenate(places), np.concatenate(parts)
                g["emb"] = np.stack([np.bincount(at_byte, flow[:, k], 256) for k in range(cfg.embedding)], 1)
                step += 1
                rate = 0.005 * max(0.02, 1 - step / steps)
                for n, v in self.w.items():
                    a, b = m[n]
                    a += 0.1 * (g[n] - a)
                    b += 0.001 * (g[n] ** 2 - b)
                    v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)


def labelled_findings(n: int, seed: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """(text, places of the secrets in it) of n texts with a finding each, every other one a secret."""
    rng = np.random.default_rng(seed)
    pick = lambda a: a[int(rng.integers(len(a)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))
    hexa, alnum, lower = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_lowercase
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "sch", "ung", "ción", "é", "eau", "ü", "ñ"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
    longer = lambda: "".join(pick(syllables[:34]) for _ in range(int(rng.integers(3, 8))))
    deco = lambda: pick(["", "", "", "", "###", "$$$", "%%%", "***", "&&&", ",", ".", "!!", " |", ":", ":"])
    prose = lambda k: " ".join((word().upper() if rng.random() < 0.05 else word()) + deco() for _ in range(k))
    names = ["token", "api_key", "apikey", "API_KEY", "secret", "client_secret", "password", "passwd", "PASSWORD", "auth_token", "access_token", "aws_secret_access_key", "private_key", "SECRET_KEY", "db_password", "bearer", "session_key", "x-api-key", "pwd", "passphrase"]
    plain = ["author", "title", "name", "note", "type", "status", "Subject", "version", "lang", "description", "category", "format", "see also", "function", "class", "import", "result", "color", "Re", "host", "path", "user", "default"]

    def digest(k: int) -> str:
        s = chars(hexa, k)
        return s.upper() if rng.random() < 0.1 else s

    def block() -> tuple[str, list[str]]:
        """A private key: heading and lines."""
        kind, alphabet = pick(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED ", "DSA "]), pick([alnum + "+/", alnum + "+/", string.ascii_letters + "+/"])
        lines = [pick(["MII", "b3Bl", "MHc", ""]) + chars(alphabet, 60) for _ in range(int(rng.integers(1, 5)))]
        return f"-----BEGIN {kind}PRIVATE KEY-----", [*lines, chars(alphabet, int(rng.integers(2, 60))) + pick(["", "=", "=="])]

    def secret() -> tuple[str, str]:
        form = int(rng.integers(20))
        value = [
            lambda: digest(pick([32, 40, 40, 64])), lambda: chars(alnum, int(rng.integers(20, 48))), lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16), lambda: pick(["ghp_", "gho_", "ghs_"]) + chars(alnum, 36),
            lambda: pick(["sk-", "sk_live_", "rk_live_", "pk_live_"]) + chars(alnum, int(rng.integers(24, 49))), lambda: "xoxb-" + chars(string.digits, 12) + "-" + chars(alnum, 24), lambda: "AIza" + chars(alnum + "_-", 35), lambda: "eyJ" + chars(alnum + "_-", 33) + ".eyJ" + chars(alnum + "_-", 60) + "." + chars(alnum + "_-", 43),
            lambda: base64.b64encode(rng.bytes(int(rng.integers(20, 90)))).decode(), lambda: chars(alnum + "!@%^&*$-_", int(rng.integers(9, 20))) + chars(string.digits, 1), lambda: digest(40), lambda: "glpat-" + chars(alnum, 20), lambda: digest(40),
            lambda: digest(int(rng.integers(10, 31))), lambda: digest(int(rng.integers(10, 31))), lambda: chars(lower + string.digits, int(rng.integers(8, 24))) + chars(string.digits, 1),
            lambda: chars(string.ascii_letters, int(rng.integers(12, 44))), lambda: chars(string.ascii_letters + "!@%^&*$", int(rng.integers(10, 24))), lambda: chars(lower, 1) + longer() + "".join(longer().capitalize() for _ in range(int(rng.integers(1, 4)))) + pick(["", "!", "$"]), lambda: longer().capitalize() + longer().capitalize() + pick(["!", "", "!!", "@" + longer()]),
        ][form]()
        lead = pick(names) + pick([" = ", "=", ": ", ":", " := ", " => ", " == ", "    : "]) + pick(['"', "'", "", '"'])
        if form in (2, 3, 4, 5, 6, 7, 11) and rng.random() < 0.4:
            lead = pick(["", "", "(", "use ", "key "])
        if form >= 18:  # phrases of words are secrets where they are quoted after a password's name
            lead = pick(["password", "passwd", "PASSWORD", "db_password", "pwd", "passphrase", "secret", "client_secret"]) + pick([" = ", "=", ": ", ":"]) + pick(['"', "'", '"'])
        elif rng.random() < 0.15:
            lead = pick(["Authorization: Bearer ", '{"%s": "' % pick(names), "export %s=" % pick(names).upper(), "--%s " % pick(names) + pick(["", "= "])])
        if not lead.rstrip(" \"'").endswith(("=", ":")) and (len(value) < 16 or not any(c.isdigit() for c in value) or any(c in "@!%^&*$" for c in value)):
            lead += "= "  # what is neither assigned nor long and with a digit is no candidate
        return lead, value

    def other() -> tuple[str, str]:
        return [
            lambda: (pick(["commit ", "sha1: ", "sha256:", "md5: ", "checksum = ", "rev ", "ETag: ", "digest: "]), digest(pick([32, 40, 64]))), lambda: (pick(["id=", "uuid: ", "", "request "]), "-".join(digest(k).lower() for k in (8, 4, 4, 4, 12))), lambda: (pick(["", "card ", "no. ", "id = ", "nr: "]), chars(string.digits, int(rng.integers(8, 21)))),
            lambda: (pick(["", "mail: ", "to: "]), chars(lower, 6) + "." + chars(string.digits, 2) + "@" + pick(["mail", "post"]) + chars(string.digits, 1) + ".example.com"), lambda: (pick(["https://", "see http://", "url: https://"]), word() + ".example.org/" + word() + "/" + chars(string.digits, 5) + "/" + word()),
            lambda: (pick(["", "path = ", "in "]), "/" + "/".join([word(), word(), "v" + chars(string.digits, 2), word()]) + ".txt"), lambda: (pick(["date: ", "", "at = "]), "20" + chars("0123", 2) + "-0" + chars("123456789", 1) + "-1" + chars(string.digits, 1) + "T10:" + chars("012345", 2)), lambda: (pick(["tel: ", "phone = ", "", "+"]), chars(string.digits, 3) + "-" + chars(string.digits, 3) + "-" + chars(string.digits, 6)),
            lambda: (pick(names) + pick([" = ", ": ", "="]) + '"', pick(["your-api-key-here-1", "xxxxxxxxxxxxxxxx0000", "changeme12345678", "example-token-0123", "0000000000000000000", "YOUR_SECRET_KEY_1", "your-password-here", "changeme-please", "PLACEHOLDER", "xxxxxxxxxxxx", "REPLACE_WITH_KEY"])), lambda: ("", word() + word() + chars(string.digits, 2) + word() + word()), lambda: (pick(["version = ", "v", "ratio: "]), ".".join(chars(string.digits, 3) for _ in range(4))),
            lambda: (pick(["", "IBAN ", "iban: "]), pick(["DE", "FR", "ES"]) + chars(string.digits, 20)), lambda: (pick(["isbn: ", "doi:", "ip = "]), "10." + chars(string.digits, 4) + "/" + word() + "." + chars(string.digits, 6)),
            lambda: ("", chars(string.digits, int(rng.integers(13, 20)))), lambda: (pick(["", "", "n = ", "x: "]), chars(string.digits, 16)),
            lambda: (pick(['{"', '"', ', "']) + pick(plain) + '": "', longer()) if rng.random() < 0.4 else (pick([*plain, word(), word().upper()]) + pick([": ", " = ", "=", ":"]) + pick(["", "", '"']), longer()), lambda: (word() + pick([": ", ":", ": "]), longer() + pick(["", ".", "-" + longer()])), lambda: (pick(names) + pick([" = ", ": ", "="]), longer() + pick(["", "_" + longer(), "." + longer(), longer().capitalize()])), lambda: (pick(plain) + pick([" = ", ": ", '": "']) + pick(["", '"']), longer() + longer().capitalize() + pick(["", longer().capitalize()])),
            lambda: (pick(plain) + pick([": ", "="]), longer() + pick(["!", "!!", "&" + longer(), "***", "%%%", "$$$", "&&&"])), lambda: ("-----BEGIN %sPRIVATE KEY-----" % pick(["", "RSA ", "EC "]) + pick(["\n", " ", "\\n"]), pick(["(redacted)", "<paste your key here>", "...", longer() + " " + longer() + " " + word(), "[removed]", prose(6), prose(9)]) + pick(["\n-----END PRIVATE KEY-----", ""])),
        ][int(rng.integers(21))]()

    out = []
    for k in range(n):
        left, inside = prose(int(rng.integers(0, 9))) + pick([" ", "\n", " "]), []
        if k % 2 == 0 and rng.random() < 0.12:
            lead, lines = block()
            br = pick(["\n", "\n", "\r\n", "\\n"])
            parts, tail = [left + pick(["", "key: ", 'pem = "']) + lead, *(br + line for line in lines)], br + lead.replace("BEGIN", "END") + pick(["\n", '"']) + prose(3)
            inside = [(len(br), len(br) + len(line)) for line in lines]
        else:
            lead, value = secret() if k % 2 == 0 else other()
            quote = lead[-1:] if lead[-1:] in "\"'" else ""
            parts, tail = [left + lead, value], (quote or pick(["", ",", ";", ".", deco()])) + pick([" ", "\n", " "]) + prose(4)
            inside = [(0, len(value.encode()))] if k % 2 == 0 else []
        text, spans = parts[0].encode(), []
        for j, part in enumerate(parts[1:]):
            if inside:
                spans.append((len(text) + inside[j][0], len(text) + inside[j][1]))
            text += part.encode()
        out.append((text + tail.encode(), spans))
    return out


def labelled_candidates(findings: list[tuple[bytes, list[tuple[int, int]]]], cfg: ScanConfig) -> tuple[np.ndarray, ...]:
    """(windows, first window by candidate, 1 for a secret, kind by candidate, secrets by kind that no candidate covers)."""
    off = np.concatenate([[0], np.cumsum([len(t) for t, _ in findings])])
    buf = np.frombuffer(b"".join(t for t, _ in findings), np.uint8)
    s, e, kind = candidates(buf, off, cfg)
    true = np.array([(off[i] + a, off[i] + b) for i, (_, spans) in enumerate(findings) for a, b in spans], np.int64).reshape(-1, 2)
    y, missed = np.zeros(len(s)), np.zeros(len(KINDS), np.int64)
    at = np.minimum(np.searchsorted(e, true[:, 0], "right"), max(len(s) - 1, 0))  # the first candidate that ends within or beyond
    for i, (a, b) in zip(at, true, strict=True):
        if len(s) and min(b, e[i]) - max(a, s[i]) > (b - a) / 2:
            y[i] = 1
        else:
            missed[_BLOCK_KIND if buf[max(0, a - 900) : a].tobytes().count(b"PRIVATE KEY-----") else _ASSIGNED_KIND] += 1
    x, first = windows(buf, off, s, e, cfg)
    return x, first, y, kind, missed


@functools.lru_cache(maxsize=4)
def trained(cfg: ScanConfig = ScanConfig()) -> tuple[Network, tuple[float, float], tuple[float, ...]]:
    """(network, Platt scaling, threshold of probability by kind of candidate)."""
    net = Network(cfg)
    x, first, y, _, _ = labelled_candidates(labelled_findings(cfg.examples, cfg.seed), cfg)
    net.train(x, np.repeat(y, np.diff(np.concatenate([first, [len(x)]]))).astype(np.float32))
    x, first, y, kind, missed = labelled_candidates(labelled_findings(cfg.examples // 2, cfg.seed + 1), cfg)
    z = np.maximum.reduceat(net.scores(x), first)
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):  # Newton steps on the calibration's likelihood
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, g = p * (1 - p) + 1e-9, p - target
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, np.array([(g * z).sum(), g.sum()]))
        a, b = a - d[0], b - d[1]
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    cut = []
    for k in range(len(KINDS)):
        q = np.sort(p[(y > 0) & (kind == k)])
        spare = (1 - cfg.recall) * (len(q) + missed[k]) - missed[k]  # how many may be lost besides those without a candidate
        cut.append(float(min(0.5, q[max(0, int(spare))])) if len(q) else 0.5)
    return net, (float(a), float(b)), tuple(cut)


def find(texts: pa.Array, cfg: ScanConfig, model: tuple) -> tuple[np.ndarray, ...]:
    """(row, start, end, start and end in characters, kind, probability) of the secrets in texts; places in bytes within the row's text."""
    net, (a, b), cut = model
    col = C.utf8(texts)
    buf, off = C.raw(col)
    out = []
    for i, j in C._slices(off):
        sub = off[i : j + 1]
        s, e, kind = candidates(buf, sub, cfg)
        if len(s):
            x, first = windows(buf, sub, s, e, cfg)
            p = 1 / (1 + np.exp(-np.clip(a * np.maximum.reduceat(net.scores(x), first) + b, -30, 30)))
            ok = p >= np.array(cut)[kind]
            s, e, kind, p = s[ok], e[ok], kind[ok], p[ok]
        if len(s):
            row = np.searchsorted(sub[1:], s, "right") + i
            chars = np.concatenate([[0], np.cumsum((buf[sub[0] : sub[-1]] & 0xC0) != 0x80)])
            of = lambda at: chars[at - sub[0]] - chars[off[row] - sub[0]]  # noqa: B023, E731
            out.append((row, s - off[row], e - off[row], of(s), of(e), kind, p))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z, z.astype(float)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def scan(docs: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """(doc_id, start, end, kind, probability, shown): every secret of every text; shown is its first 4 characters."""
    model = trained(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.table_slices(batches):
            col = C.utf8(b.column("text"))
            row, s, e, start, end, kind, p = find(col, cfg, model)
            if len(row):
                buf, off = C.raw(col)
                shown = [buf[off[r] + x : off[r] + min(x + 4, y)].tobytes().decode("utf-8", "ignore") for r, x, y in zip(row, s, e, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(end), pa.array([KINDS[k] for k in kind], pa.string()), pa.array(p), pa.array(shown, pa.string())], names=["doc_id", "start", "end", "kind", "probability", "shown"])

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, "doc_id long, start long, end long, kind string, probability double, shown string")


def redact(docs: DataFrame, cfg: ScanConfig = ScanConfig(), mask: str = "[SECRET]") -> DataFrame:
    """docs with mask in place of each secret; n_chars, if there, is the new length where the text changed."""
    model = trained(cfg)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        row, s, e, *_ = find(texts, cfg, model)
        if len(row):
            out, sign = texts.to_pylist(), mask.encode()
            cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):  # findings of a text, in order
                t, parts, at = out[row[lo]].encode(), [], 0
                for x, y in zip(s[lo:hi].tolist(), e[lo:hi].tolist(), strict=True):
                    parts += [t[at:x], sign]
                    at = y
                out[row[lo]] = b"".join([*parts, t[at:]]).decode()
            texts = pa.array(out, pa.string())
        return texts.cast(pa.string())

    new = C.fresh(docs, "_new")
    done = docs.withColumn(new, masked("text"))
    columns = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(new) == F.col("text"), F.col("n_chars")).otherwise(F.char_length(new).cast(docs.schema["n_chars"].dataType))
        columns["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(columns["n_chars"])
    return done.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])
