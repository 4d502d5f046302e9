"""Formula languages: lexers, one precedence parser, truth tables.

Formulas are parsed once for each distinct string by an Arrow function (`parsed`), which returns a
flat struct; evaluation, comparison and set metrics are then built-in expressions over that struct.
Trees inside the parser are tuples: ("atom", name), ("¬", x) or (op, left, right).

Two lexers, never to be mixed. Grammar A (curation) skips characters it doesn't know and has
one-letter atoms; grammar B (evaluation) rejects them, has longer atoms and knows words as operators,
which it also sees at the beginning of longer words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Binding strength of the connectors, and which of them group to the right or commute.
STRENGTH = {"↔": 1, "→": 2, "∨": 3, "∧": 4}
_SIGNS = ("¬", "∧", "∨", "→", "↔")
RIGHT = {"→"}
COMMUTES = {"∧", "∨", "↔"}

# Notations of grammar B by length.
NOTATIONS = {
    "¬": "¬", "~": "¬", "!": "¬", "not": "¬", "∧": "∧", "^": "∧", "&": "∧", "and": "∧", "∨": "∨", "|": "∨", "or": "∨",
    "→": "→", "->": "→", "=>": "→", "implies": "→", "↔": "↔", "<->": "↔", "<=>": "↔", "iff": "↔",
}


class FormulaError(ValueError):
    pass


_A = {"¬": "¬", "~": "¬", "∧": "∧", "&": "∧", "∨": "∨", "|": "∨", "→": "→", "->": "→", "↔": "↔", "<->": "↔", "(": "(", ")": ")"}
_A_TOKEN = re.compile(r"<->|->|[()¬~∧&∨|→↔]|[^\W\d_][\d'¹²³⁰⁴-⁹₀-₉]*")


def lex_a(text: str) -> list[str]:
    out = []
    for m in _A_TOKEN.finditer(text):
        t = m[0]
        if t in _A:
            out.append(_A[t])
        elif t[0].islower():
            out.append("@" + t)
        else:  # an upper-case letter is skipped, digits behind it too
            continue
    return out


_B_TOKEN = re.compile(r"[¬~!∧^&∨|→↔()]|<->|<=>|->|=>|not|and|iff|or|\w+|\S")  # signs (none begins another), words, anything else


def _token_b(found: str) -> str | None:
    """The token of what _B_TOKEN found; None if no formula may have it."""
    c = found[0]
    if found in NOTATIONS or found in ("(", ")"):
        return NOTATIONS.get(found, found)
    if not c.isalpha() or not (c.islower() or c.isupper()):
        return None
    return NOTATIONS[found.lower()] if c.islower() and found.lower() in NOTATIONS else "@" + (found if c.islower() else found.lower())


def lex_b(text: str) -> list[str]:
    text = text.strip()
    found = _B_TOKEN.findall(text)
    token = {x: _token_b(x) for x in set(found)}
    if None in token.values():
        m = next(m for m in _B_TOKEN.finditer(text) if token[m[0]] is None)
        raise FormulaError(f"unknown character {m[0][0]!r} at {m.start()}")
    return [token[x] for x in found]


# What a sign on the stack must have to be reduced before the next one.
_FORCE = STRENGTH | {"¬": 9, "(": 0}
_CONNECTORS = frozenset(_SIGNS)
_LEVEL = {op: n + (op in RIGHT) for op, n in STRENGTH.items()}


def postfix_of(tokens: list[str]) -> list[str]:
    """Operator precedence over either lexer's tokens, on an explicit stack; atoms carry a leading @, and none in the result."""
    signs: list[str] = []
    out: list[str] = []
    name = {t: t[1:] for t in set(tokens) if t[0] == "@"}
    due = True  # an operand is
    for t in tokens:
        if due:
            if t in name:
                out.append(name[t])
                due = False
            elif t == "(" or t == "¬":
                signs.append(t)
            else:
                raise FormulaError(f"an operand was due, not {t}")
        elif t in _LEVEL:
            level = _LEVEL[t]
            while signs and _FORCE[signs[-1]] >= level:
                out.append(signs.pop())
            signs.append(t)
            due = True
        elif t == ")":
            while signs and signs[-1] != "(":
                out.append(signs.pop())
            if not signs:
                raise FormulaError("unexpected )")
            signs.pop()
        else:
            raise FormulaError(f"unexpected {t.lstrip('@')}" if "(" not in signs else "a parenthesis is open")
    if due:
        raise FormulaError("the formula ends too early")
    if "(" in signs:
        raise FormulaError("a parenthesis is open")
    return out + signs[::-1]


def tree_of(rpn: list[str]):
    """The tree of a postfix form. Equal subtrees are one object."""
    trees: list[tuple] = []
    same: dict[tuple, tuple] = {}
    for t in rpn:
        if t not in _FORCE:
            node = same.setdefault((t,), ("atom", t))
        elif t == "¬":
            x = trees.pop()
            node = same.setdefault((t, id(x)), (t, x))
        else:
            right, left = trees.pop(), trees.pop()
            node = same.setdefault((t, id(left), id(right)), (t, left, right))
        trees.append(node)
    return trees[0]


def parse_tokens(tokens: list[str]):
    return tree_of(postfix_of(tokens))


def tokens_b(text: str | None) -> list[str]:
    if text is None or not text.strip():
        raise FormulaError("empty formula")
    return lex_b(text)


def parse_b(text: str):
    return parse_tokens(tokens_b(text))


def nodes(tree) -> list[tuple]:
    """All nodes from the leaves up, left before right; a node that occurs twice is in it twice."""
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        out.append(t)
        if len(t) == 3:
            todo.append(t[1])
            todo.append(t[2])
        elif t[0] == "¬":
            todo.append(t[1])
    return out[::-1]


def postfix(tree) -> list[str]:
    return [t[1] if t[0] == "atom" else t[0] for t in nodes(tree)]


def names(tree) -> set[str]:
    return {t[1] for t in nodes(tree) if t[0] == "atom"}


def connectors(tree) -> list[str]:
    """In reading order: a negation before its operand, a binary sign between its operands."""
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, str):
            out.append(t)
        elif t[0] == "¬":
            todo += [t[1], "¬"]
        elif t[0] != "atom":
            todo += [t[2], t[0], t[1]]
    return out


def _weak(t, side: int, strict: bool) -> bool:
    """Whether a binary node's side stands in parentheses."""
    x = t[side]
    return len(x) == 3 and (STRENGTH[x[0]] < STRENGTH[t[0]] or (strict and side == 1 and x[0] == t[0] == "→"))


def show(tree, strict: bool = False) -> str:
    """Print a tree. The plain mode leaves out parentheses between equal connectors even where that changes
    the grouping of implications; strict keeps those of an implication's left side."""
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, str):
            out.append(t)
        elif t[0] == "atom":
            out.append(t[1])
        elif t[0] == "¬":
            todo += [")", t[1], "¬("] if len(t[1]) == 3 else [t[1], "¬"]
        else:
            sides = [[")", t[k], "("] if _weak(t, k, strict) else [t[k]] for k in (2, 1)]
            todo += [*sides[0], f" {t[0]} ", *sides[1]]
    return "".join(out)


#: Characters of a printed subtree that are kept to compare it with another.
_HEAD = 48


def canonical(tree, strict: bool = False):
    """Without double negations, operands of commutative connectors in order of their printed form."""
    done: dict[int, tuple] = {}
    heads: dict[int, tuple[str, bool]] = {}  # of a canonical node: the beginning of its printed form, and whether that is all
    alive = []

    def joined(*parts) -> tuple[str, bool]:
        text = ""
        for part in parts:
            piece, whole = (part, True) if isinstance(part, str) else heads[id(part)]
            text += piece
            if not whole or len(text) > _HEAD:
                return text[:_HEAD], False
        return text, True

    def after(x, y) -> bool:
        (a, whole_a), (b, whole_b) = heads[id(x)], heads[id(y)]
        n = min(len(a), len(b))
        if a[:n] != b[:n] or (whole_a and whole_b) or (whole_a and n == len(a)) or (whole_b and n == len(b)):
            return a > b
        return x is not y and show(x, strict) > show(y, strict)

    for t in nodes(tree):
        if id(t) in done:
            continue
        if t[0] == "atom":
            out = t
        elif t[0] == "¬":
            inner = done[id(t[1])]
            out = inner[1] if inner[0] == "¬" else ("¬", inner)
        else:
            left, right = done[id(t[1])], done[id(t[2])]
            out = (t[0], right, left) if t[0] in COMMUTES and after(left, right) else (t[0], left, right)
        if id(out) not in heads:
            if out[0] == "atom":
                heads[id(out)] = joined(out[1])
            elif out[0] == "¬":
                heads[id(out)] = joined("¬(", out[1], ")") if len(out[1]) == 3 else joined("¬", out[1])
            else:
                sides = [("(", out[k], ")") if _weak(out, k, strict) else (out[k],) for k in (1, 2)]
                heads[id(out)] = joined(*sides[0], f" {out[0]} ", *sides[1])
        done[id(t)] = out
        alive.append(out)
    return done[id(tree)]


def subformulas(tree, strict: bool = False) -> list[str]:
    """Printed forms of all nodes but atoms; together they are as long as the square of a long chain."""
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, str):
            out.append(t)
        elif t[0] == "¬":
            todo += [t[1], show(t, strict)]
        elif t[0] != "atom":
            todo += [show(t, strict), t[2], t[1]]
    return out


def truth_bits(tree, atoms: list[str]) -> int:
    """The truth table as an integer of 2^n bits, row 0 (all false) lowest; the first atom is the most significant."""
    n = len(atoms)
    size = 1 << n
    full = (1 << size) - 1
    lanes = {}
    for k, a in enumerate(atoms):
        half = 1 << (n - 1 - k)
        lanes[a] = full // ((1 << half) + 1) << half

    done = {}
    for t in nodes(tree):
        if id(t) in done:
            continue
        if t[0] == "atom":
            done[id(t)] = lanes[t[1]]
        elif t[0] == "¬":
            done[id(t)] = full ^ done[id(t[1])]
        else:
            a, b = done[id(t[1])], done[id(t[2])]
            done[id(t)] = {"∧": a & b, "∨": a | b, "→": full ^ a | b, "↔": full ^ a ^ b}[t[0]]
    return done[id(tree)]


#: Steps of a decision diagram after which a formula has no signature.
STEPS = 50_000


def _diagrams(formulas: list[list[str]], steps: int) -> tuple[list[tuple], list[int], list[str]] | None:
    """Postfix forms as one reduced decision diagram over the atoms in order of name: the diagram, the formulas' roots in it, and the atoms; None if it
    takes more steps. Formulas of one root are equivalent."""
    order = {a: i for i, a in enumerate(sorted(set().union(*formulas) - _FORCE.keys()))}
    diagram: list[tuple] = [(len(order), 0, 0), (len(order), 1, 1)]  # false, true
    known: dict[tuple, int] = {}
    memo: dict[tuple, int] = {}

    def node(level: int, low: int, high: int) -> int:
        if low == high:
            return low
        key = (level, low, high)
        if key not in known:
            known[key] = len(diagram)
            diagram.append(key)
        return known[key]

    def both(op: str, a: int, b: int) -> int:
        if a < 2 and b < 2:
            return int({"∧": a and b, "∨": a or b, "→": not a or b, "↔": a == b}[op])
        key = (op, a, b)
        if key not in memo:
            if len(memo) >= steps:
                raise RecursionError
            level = min(diagram[a][0], diagram[b][0])
            (a0, a1), (b0, b1) = (diagram[x][1:] if diagram[x][0] == level else (x, x) for x in (a, b))
            memo[key] = node(level, both(op, a0, b0), both(op, a1, b1))
        return memo[key]

    atoms = {a: node(i, 0, 1) for a, i in order.items()}
    roots = []
    try:
        for rpn in formulas:
            stack: list[int] = []
            for t in rpn:
                if t in atoms:
                    stack.append(atoms[t])
                elif t == "¬":
                    stack.append(both("→", stack.pop(), 0))
                else:
                    right = stack.pop()
                    key = (t, stack[-1], right)
                    stack[-1] = memo[key] if key in memo else both(*key)
            roots += stack
    except RecursionError:
        return None
    return diagram, roots, list(order)


def signature(tree, steps: int = STEPS) -> str | None:
    """Equal for two formulas exactly if they are equivalent; None if it takes more steps, and for formulas of some hundred atoms.

    It is the reduced decision diagram over the atoms in order of name, written from its root; an atom that
    doesn't matter is not in it. Long ones are given by their SHA-256. Formulas without one are compared by `equivalent`.
    """
    made = _diagrams([postfix(tree)], steps)
    if made is None:
        return None
    diagram, (root,), names_of = made
    place, out, todo = {0: "F", 1: "T"}, [], [root]
    while todo:
        x = todo.pop()
        if x not in place:
            place[x] = str(len(place) - 2)
            out.append(x)
            todo += [diagram[x][2], diagram[x][1]]
    text = ";".join(f"{names_of[diagram[x][0]]}?{place[diagram[x][2]]}:{place[diagram[x][1]]}" for x in out) or place[root]
    return text if len(text) < 200 else hashlib.sha256(text.encode()).hexdigest()


def equivalent(a: list[str], b: list[str], conflicts: int = 20_000) -> bool | None:
    """Whether two formulas in postfix form are; by one diagram of both where it takes no more steps than two signatures, else by a search for an assignment on which they differ, None if it meets too many conflicts."""
    from .solver import Clauses

    made = _diagrams([a, b], 2 * STEPS)
    if made is not None:
        left, right = made[1]
        return left == right
    clauses = Clauses()
    x, y = clauses.formula(nodes(tree_of(a))), clauses.formula(nodes(tree_of(b)))
    if abs(x) == abs(y):
        return x == y
    clauses.add([x, y])
    clauses.add([-x, -y])
    found = clauses.solve(conflicts)
    return None if found is None else not found


_STRINGS = T.ArrayType(T.StringType())
_SYNTAX = [
    T.StructField("valid", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("rpn", _STRINGS), T.StructField("atoms", _STRINGS),
    T.StructField("connectors", _STRINGS), T.StructField("main", T.StringType()),
]
_MEANING = [T.StructField("canonical", T.StringType()), T.StructField("signature", T.StringType())]
_PARTS = [T.StructField("subs", _STRINGS), T.StructField("sub_signatures", _STRINGS)]
#: What the parse of a formula gives: its syntax; with its printed canonical form and signature; with its subformulas too.
SYNTAX, PARSED, WHOLE = T.StructType(_SYNTAX), T.StructType(_SYNTAX + _MEANING), T.StructType(_SYNTAX + _MEANING + _PARTS)
CHECKED = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("atoms", _STRINGS)])


def remembered(limit: int) -> Callable:
    """Keep a function's latest results by its arguments, as long as the strings in both have at most about twice `limit`
    characters: long formulas don't pile up in a worker. Results don't depend on it."""

    def size(x) -> int:
        return len(x) if isinstance(x, str) else 40 + sum(map(len, x)) if isinstance(x, list) else 0

    def keep(fn: Callable) -> Callable:
        new: dict = {}
        old: dict = {}
        held = 0

        @wraps(fn)
        def call(*key):
            nonlocal new, old, held
            if key in new:
                return new[key]
            out = old[key] if key in old else fn(*key)
            own = 40 + sum(map(size, key)) + (sum(map(size, out)) if isinstance(out, tuple) else 0)
            if held + own > limit:
                new, old, held = {}, new, 0
            if own <= limit:
                new[key] = out
                held += own
            return out

        return call

    return keep


@remembered(1_000_000)
def _tree(text: str | None):
    """The parsed tree, or the error's message."""
    try:
        return parse_b(text)
    except FormulaError as e:
        return str(e)[:200]


@remembered(4_000_000)
def analyse(text: str | None, strict: bool = False, fields: int = len(WHOLE)) -> tuple:
    """The first fields of WHOLE; no more is computed."""
    try:
        tokens = tokens_b(text)
        rpn = postfix_of(tokens)
    except FormulaError as e:
        return (False, str(e)[:200], None, None, None, None, text.strip() if text is not None else None, None, None, None)[:fields]
    out = (True, "", rpn, sorted(set(rpn) - _FORCE.keys()), [t for t in tokens if t in _CONNECTORS], rpn[-1] if len(rpn) > 1 else None)
    if fields > len(SYNTAX):
        tree = tree_of(rpn)
        out += (show(canonical(tree, strict), strict), signature(tree))
    if fields > len(PARSED):
        subs = sorted(set(subformulas(tree, strict)))
        out += (subs, [signature(parse_b(s)) or s for s in subs])
    return out


def _parser(kind: T.StructType, strict: bool = False):
    @F.pandas_udf(kind)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([analyse(t, strict, len(kind)) for t in texts], columns=kind.names)

    return parse


syntax, parsed, parsed_whole = _parser(SYNTAX), _parser(PARSED), _parser(WHOLE)


def validity(formula: Column, struct: Column) -> Column:
    """struct<valid, message> of a formula and its `parsed` struct. The messages of a valid and of an empty formula."""
    empty = F.length(F.regexp_replace(F.coalesce(formula, F.lit("")), r"(?U)\s", "")) == 0
    return F.struct(struct.valid.alias("valid"), F.when(struct.valid, "OK").when(empty, "Formula vacia").otherwise(struct.error).alias("message"))


def check_a(text: str | None) -> tuple[bool, list[str]]:
    """Whether grammar A accepts a text, and its atoms."""
    try:
        tree = parse_tokens(lex_a(text or ""))
        return True, sorted(names(tree))
    except FormulaError:
        return False, []


@F.pandas_udf(CHECKED)
def checked(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([check_a(t) for t in texts], columns=CHECKED.names)


def distance(a, b) -> int:
    """Simplified edit distance of two trees, each pair of different subtrees computed once."""
    sizes: dict[int, int] = {}
    for tree in (a, b):
        for t in nodes(tree):
            sizes[id(t)] = 1 if t[0] == "atom" else 1 + sum(sizes[id(x)] for x in t[1:])
    known: dict[tuple[int, int], int] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        key = (id(x), id(y))
        if key in known:
            todo.pop()
            continue
        if x[0] == y[0] == "atom":
            known[key] = int(x[1] != y[1])
        elif len(x) != len(y) or "atom" in (x[0], y[0]) or (len(x) == 2 and x[0] != y[0]):
            known[key] = sizes[id(x)] + sizes[id(y)]
        else:
            turned = len(x) == 3 and x[0] == y[0] and x[0] in COMMUTES
            pairs = [(x[1], y[1])] if len(x) == 2 else [(x[1], y[1]), (x[2], y[2])] + ([(x[1], y[2]), (x[2], y[1])] if turned else [])
            open_ = [p for p in pairs if (id(p[0]), id(p[1])) not in known]
            if open_:
                todo += open_
                continue
            d = [known[id(p[0]), id(p[1])] for p in pairs]
            known[key] = d[0] if len(x) == 2 else min([int(x[0] != y[0]) + d[0] + d[1], *([d[2] + d[3]] if turned else [])])
    return known[id(a), id(b)]


def credit(prediction: str | None, reference: str | None) -> float:
    a, b = _tree(prediction or ""), _tree(reference or "")
    if isinstance(a, str) or isinstance(b, str):
        return 0.0
    return max(0.0, 1 - distance(a, b) / max(len(nodes(a)), len(nodes(b))))


@F.pandas_udf(T.DoubleType())
def partial_credit(predictions: pd.Series, references: pd.Series) -> pd.Series:
    return pd.Series([credit(p, r) for p, r in zip(predictions, references)])


@F.pandas_udf(T.BooleanType())
def same_meaning(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two valid formulas are equivalent; null for invalid ones, and where `equivalent` can't tell."""
    return pd.Series([meaning(a, b) for a, b in zip(left, right)], dtype=object)


@remembered(4_000_000)
def meaning(left: str | None, right: str | None) -> bool | None:
    try:
        return equivalent(postfix_of(tokens_b(left)), postfix_of(tokens_b(right)))
    except FormulaError:
        return None


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: one addition of whole rows as integers for each element of b."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


# Built-in expressions over postfix arrays.

#: Truth-table columns of six atoms as signed 64-bit masks, most significant atom first. Fixed values.
LANES = (-4294967296, -281470681808896, -71777214294589696, -1085102592571150096, -3689348814741910324, -6148914691236517206)


def truth_words(rpn: Column, atoms: Column) -> Column:
    """The truth table, 64 rows in each word; atoms gives each atom's place (use the union of both formulas' atoms
    to compare two). n atoms make 2^(n - 6) words, at least one."""
    lanes = F.array(*[F.lit(x) for x in LANES])
    top = lambda s, k: F.element_at(s, -k)
    cut = lambda s, k: F.slice(s, F.lit(1), F.size(s) - k)
    more = F.greatest(F.size(atoms) - 6, F.lit(0))  # the first atoms are bits of the word's number

    def word(w):
        def lane(t):
            i = F.array_position(atoms, t).cast("int") - 1
            bit = F.call_function("shiftright", w, more - 1 - i).bitwiseAND(F.lit(1))
            return F.when(i < more, -bit).otherwise(F.get(lanes, i - more)).cast("bigint")

        def step(s, t):
            a, b = top(s, 2), top(s, 1)
            both = F.when(t == "∧", a.bitwiseAND(b)).when(t == "∨", a.bitwiseOR(b)).when(t == "→", F.bitwise_not(a).bitwiseOR(b)).otherwise(F.bitwise_not(a.bitwiseXOR(b)))
            return F.when(t == "¬", F.concat(cut(s, 1), F.array(F.bitwise_not(b)))).when(t.isin(*_SIGNS), F.concat(cut(s, 2), F.array(both))).otherwise(F.concat(s, F.array(lane(t))))

        return F.element_at(F.aggregate(rpn, F.array().cast("array<bigint>"), step), 1)

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), more) - 1), word)


def evaluate(rpn: Column, assignment: Column) -> Column:
    """Value of a formula under a map of atom to boolean."""
    top = lambda s, k: F.element_at(s, -k)
    cut = lambda s, k: F.slice(s, F.lit(1), F.size(s) - k)

    def step(s, t):
        a, b = top(s, 2), top(s, 1)
        both = F.when(t == "∧", a & b).when(t == "∨", a | b).when(t == "→", ~a | b).otherwise(a == b)
        return F.when(t == "¬", F.concat(cut(s, 1), F.array(~b))).when(t.isin(*_SIGNS), F.concat(cut(s, 2), F.array(both))).otherwise(F.concat(s, F.array(F.try_element_at(assignment, t))))

    return F.element_at(F.aggregate(rpn, F.array().cast("array<boolean>"), step), 1)


def node_count(rpn: Column) -> Column:
    return F.size(rpn)


def truth_table(df: DataFrame, formula: str = "formula") -> DataFrame:
    """df's rows times the rows of each valid formula's truth table: row_no, assignment (map) and value.

    Atoms are sorted; the first is the most significant and false comes before true. A formula of n
    atoms has 2^n rows, by nature.
    """
    p = df.withColumn("_p", syntax(F.col(formula))).where("_p.valid")
    n = F.size("_p.atoms")
    rows = p.withColumn("row_no", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), n).cast("long") - 1)))
    values = F.transform("_p.atoms", lambda a, i: (F.floor(F.col("row_no") / F.pow(F.lit(2.0), n - 1 - i)) % 2) == 1)
    out = rows.withColumn("assignment", F.map_from_arrays("_p.atoms", values))
    return out.withColumn("value", evaluate(F.col("_p.rpn"), F.col("assignment"))).drop("_p")


def format_truth_table(df: DataFrame, formula: str = "formula") -> DataFrame:
    """One text table for each distinct valid formula: atoms and formula, a rule, then T and F."""
    t = truth_table(df.select(formula).distinct(), formula)
    atoms = F.map_keys("assignment")
    cell = F.array_join(F.transform(F.map_values("assignment"), lambda v: F.when(v, "T").otherwise("F")), " | ")
    pad = F.repeat(F.lit(" "), F.floor(F.length(formula) / 2).cast("int"))
    line = F.concat(cell, F.lit(" | "), pad, F.when(F.col("value"), "T").otherwise("F"))
    rule = F.concat(F.array_join(F.transform(atoms, lambda a: F.repeat(F.lit("-"), F.length(a))), "-|-"), F.lit("-|-"), F.repeat(F.lit("-"), F.length(formula)))
    head = F.concat(F.array_join(atoms, " | "), F.lit(" | "), F.col(formula))
    g = t.groupBy(formula).agg(F.first(head).alias("head"), F.first(rule).alias("rule"), F.sort_array(F.collect_list(F.struct("row_no", line.alias("line")))).alias("lines"))
    return g.select(formula, F.concat_ws("\n", "head", "rule", F.array_join("lines.line", "\n")).alias("table"))
