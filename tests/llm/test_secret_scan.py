import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import secret_scan
from sparkweave.llm.automaton import Automaton

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SCANNER = secret_scan.Scanner()


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


PIECES = ["password", "passwd", "SECRET", "token", "api_key", "apikey", "'", '"', " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "x", "é", "Zz09+/", "ABCDEFGHIJKLMN12", "\n", "eyJab.eyJcd.ef", "ghp_" + "a1" * 12, "ghp_", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "sk_live_", "a1b2c3d4e5"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_spans_equal_a_regex_engine(pieces):
    text = "".join(pieces)
    data = text.encode()
    got = [(len(data[:s].decode()), k, len(data[:e].decode())) for s, k, e in SCANNER.spans(data) if SCANNER.rules[k].base]
    assert got == base_spans(text)


ADDED = {
    3: re.compile("gh[pousr]_[A-Za-z0-9]{20,}"), 4: re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 5: re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    6: re.compile("xox[abprs]-[A-Za-z0-9-]{10,}"), 7: re.compile("[sr]k_live_[A-Za-z0-9]{10,}"),
}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_added_spans_equal_a_regex_engine(pieces):
    data = "".join(pieces).encode()
    got = [(s, k, e) for s, k, e in SCANNER.spans(data) if not SCANNER.rules[k].base]
    assert got == sorted((m.start(), k, m.end()) for k, p in ADDED.items() for m in re.finditer(p.pattern.encode(), data))


def test_hostile_texts_take_linear_time():
    for unit in (b"eyJ", b"ghp_", b"AKIA", b"xoxb-", b"-----BEGIN ", b"sk_live_", b"password ", b"secret", b"eyJa.", b"eyJa.eyJ"):
        took = []
        for size in (50_000, 200_000):
            began = time.process_time()
            SCANNER.spans(unit * (size // len(unit)) + b". eyJab.eyJcd.ef")
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.3, (unit, took)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["a(b|c)*d", "x{2,4}y?", "[^a]b+", "(ab|a)(c|bcd)", "a.{0,2}c", "\\d+\\.\\d{2}"]), st.text("abcdxy.12", max_size=12))
def test_longest_match(pattern, text):
    automaton = Automaton([(pattern, False)])
    ends = [e for e in range(len(text) + 1) if re.fullmatch(pattern, text[:e])]
    assert automaton.longest(text.encode().translate(automaton.classes))[0] == max(ends, default=-1)


def test_minimal():
    assert Automaton([("a|b|c", False)]).size == 3
    assert Automaton([("(a|b)*abb", False)], search=False).size == 5  # four states and the dead one


def test_rows(spark):
    rows = [(1, "key: token = 'abcdefghijkl'", "x"), (2, None, "x"), (3, "", "x"), (None, "AKIA" + "Z" * 14, "x"), (1, "é " * 50_000 + "a1" * 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secret_scan.scan(docs).collect()}
    assert got == {(1, 1, 0, 0, "assign:5:26"), (2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (None, 0, 1, 0, "access:0:18"), (1, 0, 0, 1, "hex:100000:100016")}
    assert secret_scan.scan(docs.limit(0)).count() == 0
    assert secret_scan.scan(docs).columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
