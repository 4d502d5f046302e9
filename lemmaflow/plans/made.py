"""Formulas made from a number, as Spark columns, and the facts about them as SQL.

The driver's tables have no formulas, so each document gets two, its reference and a prediction. Both are
put together from the digits of a number that follows from the doc_id: a shape, connectors, atoms, negations and a notation.
The SQL never parses a formula: it computes what is true of it (validity, atoms, truth values, canonical form, distance)
from those digits, so it is an independent evaluator over many thousands of formulas.

Shapes: 0 `A`, 1 `A o1 B`, 2 `(A o2 B) o1 C`, 3 `A o1 (B o2 C)`, 4 `¬(A o2 B) o1 C`, 5 `(A o2 B) o1 (C o3 D)`,
6 `A o1 o2 B` and 7 `(A o1 B` (no formulas), 8 `¬¬A o1 B`. A to D are atoms, some behind a negation.
Notations: 0 spaces around connectors, 1 none, 2 ASCII with spaces.
Predictions by doc_id modulo 5: 0 the reference's own formula, 1 with its sides exchanged (shapes 1 and 5),
2 with another first atom, 3 with another main connector, 4 with a connector too many; all in notation 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATOMS = "pqrstuw"
OPS = ("∧", "∨", "→", "↔")
ASCII = ("&", "|", "->", "<->")
STRENGTH = (4, 3, 2, 1)
PRIME, FACTOR = 2147483647, 48271
#: Digit: (divisor, base).
DIGITS = {"shape": (1, 9), "o1": (9, 4), "o2": (36, 4), "o3": (144, 4), "a": (576, 7), "b": (4032, 7), "c": (28224, 7), "d": (197568, 7), "neg": (1382976, 16)}
INVALID = (6, 7)


def _digits(doc: Column) -> dict[str, Column]:
    h = (doc * FACTOR + 11) % PRIME
    return {k: (F.floor(h / div) % base).cast("int") for k, (div, base) in DIGITS.items()}


def _text(g: dict[str, Column], style: Column) -> Column:
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
    sign = F.when(style == 2, "~").otherwise("¬")
    gap = F.when(style == 1, "").otherwise(" ")
    op = {k: F.when(style == 2, pick(ASCII, g[k])).otherwise(pick(OPS, g[k])) for k in ("o1", "o2", "o3")}
    leaf = {k: F.concat(F.when(F.floor(g["neg"] / 2**i) % 2 == 1, sign).otherwise(""), pick(ATOMS, g[k])) for i, k in enumerate("abcd")}
    two = lambda x, o, y: F.concat(x, gap, op[o], gap, y)
    par = lambda x: F.concat(F.lit("("), x, F.lit(")"))
    a, b, c, d = (leaf[k] for k in "abcd")
    shapes = (
        a, two(a, "o1", b), two(par(two(a, "o2", b)), "o1", c), two(a, "o1", par(two(b, "o2", c))), two(F.concat(sign, par(two(a, "o2", b))), "o1", c),
        two(par(two(a, "o2", b)), "o1", par(two(c, "o3", d))), F.concat(a, gap, op["o1"], gap, op["o2"], gap, b), F.concat(F.lit("("), two(a, "o1", b)), two(F.concat(sign, sign, a), "o1", b),
    )
    out = F.when(F.lit(False), F.lit(""))
    for k, s in enumerate(shapes):
        out = out.when(g["shape"] == k, s)
    return out


def formulas(docs: DataFrame) -> DataFrame:
    """docs with formula (the reference), plain (the same in notation 0) and prediction."""
    doc = F.col("doc_id")
    g, kind = _digits(doc), doc % 5
    bits = [F.floor(g["neg"] / 2**i) % 2 for i in range(4)]
    ab = (kind == 1) & (g["shape"] == 1)
    cd = (kind == 1) & (g["shape"] == 5)
    swap = {"a": F.when(ab, g["b"]).when(cd, g["c"]), "b": F.when(ab, g["a"]).when(cd, g["d"]), "c": F.when(cd, g["a"]), "d": F.when(cd, g["b"]), "o2": F.when(cd, g["o3"]), "o3": F.when(cd, g["o2"])}
    order = F.when(ab, bits[1] + 2 * bits[0] + 4 * bits[2] + 8 * bits[3]).when(cd, bits[2] + 2 * bits[3] + 4 * bits[0] + 8 * bits[1]).otherwise(g["neg"])
    p = g | {k: F.coalesce(v, g[k]) for k, v in swap.items()} | {"neg": order}
    p["a"] = F.when(kind == 2, (p["a"] + 1) % 7).otherwise(p["a"])
    p["o1"] = F.when(kind == 3, (p["o1"] + 1) % 4).otherwise(p["o1"])
    # What an array holds is computed once, where Generate makes rows of it: first the digits, then each of the texts, so no expression is repeated in another.
    digits = F.struct(*[x[k].cast("int").alias(f"{side}_{k}") for side, x in (("_g", g), ("_p", p)) for k in g])
    d = docs.select("*", F.inline(F.array(digits)))
    left, right = ({k: F.col(f"{side}_{k}") for k in g} for side in ("_g", "_p"))
    for name, text in (("formula", _text(left, (F.col("doc_id") % 3).cast("int"))), ("plain", _text(left, F.lit(0))), ("prediction", F.concat(_text(right, F.lit(0)), F.when(F.col("doc_id") % 5 == 4, " ∧").otherwise("")))):
        d = d.select("*", F.explode(F.array(text)).alias(name))
    return d.select(*docs.columns, "formula", "plain", "prediction")


# SQL.

_pick = lambda values, i: "[" + ", ".join(f"'{v}'" for v in values) + f"][({i}) + 1]"


def _two(x: str, o: str, y: str, ops=OPS, gap: str = "' '") -> str:
    return f"{x} || {gap} || {_pick(ops, o)} || {gap} || {y}"


def _shape(*cases: str) -> str:
    return "CASE shape " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases) if c) + " END"


def text_sql(leaf, sign: str, ops, gap: str) -> str:
    a, b, c, d = map(leaf, "abcd")
    two = lambda x, o, y: _two(x, o, y, ops, gap)
    par = lambda x: f"'(' || {x} || ')'"
    return _shape(
        a, two(a, "o1", b), two(par(two(a, "o2", b)), "o1", c), two(a, "o1", par(two(b, "o2", c))), two(f"'{sign}' || " + par(two(a, "o2", b)), "o1", c), two(par(two(a, "o2", b)), "o1", par(two(c, "o3", d))),
        f"{a} || {gap} || {_pick(ops, 'o1')} || {gap} || {_pick(ops, 'o2')} || {gap} || {b}", f"'(' || {two(a, 'o1', b)}", two(f"'{sign}{sign}' || {a}", "o1", b),
    )


def _styled(make) -> str:
    return f"CASE style WHEN 0 THEN {make('¬', OPS, chr(39) + ' ' + chr(39))} WHEN 1 THEN {make('¬', OPS, chr(39) * 2)} ELSE {make('~', ASCII, chr(39) + ' ' + chr(39))} END"


def _leaf(sign: str, name=lambda k: _pick(ATOMS, k)):
    return lambda k: f"(CASE WHEN n{k} = 1 THEN '{sign}' ELSE '' END || {name(k)})"


_OP = lambda o, x, y: f"(CASE {o} WHEN 0 THEN ({x}) AND ({y}) WHEN 1 THEN ({x}) OR ({y}) WHEN 2 THEN NOT ({x}) OR ({y}) ELSE ({x}) = ({y}) END)"
_BIT = lambda k: f"(((z >> {k}) & 1 = 1) <> (n{k} = 1))"
#: Truth value under the assignment z, in which bit i is the value of ATOMS[i].
VALUE = _shape(
    _BIT("a"), _OP("o1", _BIT("a"), _BIT("b")), _OP("o1", _OP("o2", _BIT("a"), _BIT("b")), _BIT("c")), _OP("o1", _BIT("a"), _OP("o2", _BIT("b"), _BIT("c"))), _OP("o1", f"NOT {_OP('o2', _BIT('a'), _BIT('b'))}", _BIT("c")),
    _OP("o1", _OP("o2", _BIT("a"), _BIT("b")), _OP("o3", _BIT("c"), _BIT("d"))), "", "", _OP("o1", _BIT("a"), _BIT("b")),
)
_neg = lambda k: f"CASE WHEN n{k} = 1 THEN ['¬'] ELSE [] END"
_op = lambda o: f"[{_pick(OPS, o)}]"
_cat = lambda *xs: "list_concat(" * (len(xs) - 1) + xs[0] + "".join(f", {x})" for x in xs[1:])
CONNECTORS = _shape(
    _neg("a"), _cat(_neg("a"), _op("o1"), _neg("b")), _cat(_neg("a"), _op("o2"), _neg("b"), _op("o1"), _neg("c")), _cat(_neg("a"), _op("o1"), _neg("b"), _op("o2"), _neg("c")), _cat("['¬']", _neg("a"), _op("o2"), _neg("b"), _op("o1"), _neg("c")),
    _cat(_neg("a"), _op("o2"), _neg("b"), _op("o1"), _neg("c"), _op("o3"), _neg("d")), "", "", _cat("['¬', '¬']", _neg("a"), _op("o1"), _neg("b")),
)
LEAVES = "[a, b, c, d][:CASE shape WHEN 0 THEN 1 WHEN 5 THEN 4 WHEN 1 THEN 2 WHEN 6 THEN 2 WHEN 7 THEN 2 WHEN 8 THEN 2 ELSE 3 END]"
_NAMES = f"list_sort(list_distinct(list_transform({LEAVES}, lambda i: {_pick(ATOMS, 'i')})))"
#: Atoms that are not directly behind a negation sign, in order of text.
SEEN = f"list_filter(list_transform(range(1, len({LEAVES}) + 1), lambda i: CASE WHEN [na, nb, nc, nd][i] = 0 AND NOT (shape = 8 AND i = 1) THEN {_pick(ATOMS, f'({LEAVES})[i]')} END), lambda x: x IS NOT NULL)"


def _canonical() -> str:
    strength = lambda o: f"[{', '.join(map(str, STRENGTH))}][{o} + 1]"
    commutes = lambda o: f"{o} <> 2"
    leaf = _leaf("¬")
    low, high = (lambda o, x, y, f=f: f"CASE WHEN {commutes(o)} AND {x} > {y} THEN {y if f else x} ELSE {x if f else y} END" for f in (True, False))
    sub = lambda o, x, y: f"(({low(o, x, y)}) || ' ' || {_pick(OPS, o)} || ' ' || ({high(o, x, y)}))"
    wrap = lambda s, o: f"(CASE WHEN {strength(o)} < {strength('o1')} THEN '(' || {s} || ')' ELSE {s} END)"

    def whole(x, wx, y, wy):
        return f"(CASE WHEN {commutes('o1')} AND {x} > {y} THEN {wy} || ' ' || {_pick(OPS, 'o1')} || ' ' || {wx} ELSE {wx} || ' ' || {_pick(OPS, 'o1')} || ' ' || {wy} END)"

    a, b, c, d = map(leaf, "abcd")
    ab, bc, cd = sub("o2", a, b), sub("o2", b, c), sub("o3", c, d)
    neg = f"('¬(' || {ab} || ')')"
    return _shape(a, whole(a, a, b, b), whole(ab, wrap(ab, "o2"), c, c), whole(a, a, bc, wrap(bc, "o2")), whole(neg, neg, c, c), whole(ab, wrap(ab, "o2"), cd, wrap(cd, "o3")), "", "", whole(a, a, b, b))


def _printed() -> tuple[str, str]:
    """The whole formula as printed from its tree, and the list of its subformulas."""
    strength = lambda o: f"[{', '.join(map(str, STRENGTH))}][{o} + 1]"
    leaf = _leaf("¬")
    a, b, c, d = map(leaf, "abcd")
    sub = lambda o, x, y: f"({x} || ' ' || {_pick(OPS, o)} || ' ' || {y})"
    wrap = lambda s, o: f"(CASE WHEN {strength(o)} < {strength('o1')} THEN '(' || {s} || ')' ELSE {s} END)"
    ab, bc, cd = sub("o2", a, b), sub("o2", b, c), sub("o3", c, d)
    neg = f"('¬(' || {ab} || ')')"
    twice = f"('¬¬' || {a})"
    whole = _shape(a, sub("o1", a, b), sub("o1", wrap(ab, "o2"), c), sub("o1", a, wrap(bc, "o2")), sub("o1", neg, c), sub("o1", wrap(ab, "o2"), wrap(cd, "o3")), "", "", sub("o1", twice, b))
    own = lambda k: f"CASE WHEN n{k} = 1 THEN {leaf(k)} END"
    parts = _shape(
        f"[{own('a')}]", f"[{own('a')}, {own('b')}, whole]", f"[{own('a')}, {own('b')}, {own('c')}, {ab}, whole]", f"[{own('a')}, {own('b')}, {own('c')}, {bc}, whole]", f"[{own('a')}, {own('b')}, {own('c')}, {ab}, {neg}, whole]",
        f"[{own('a')}, {own('b')}, {own('c')}, {own('d')}, {ab}, {cd}, whole]", "", "", f"[{own('a')}, {own('b')}, '¬' || {a}, {twice}, whole]",
    )
    return whole, parts


_WHOLE, _PARTS = _printed()
_RAW = ", ".join(f"((h // {div}) % {base})::INT AS g_{k}" for k, (div, base) in DIGITS.items())
_SWAP = "((doc_id % 5 = 1) AND side = 'p')"
_N = [f"((g_neg >> {i}) & 1)" for i in range(4)]
_two_ways = lambda plain, ab, cd: f"CASE WHEN {_SWAP} AND g_shape = 1 THEN {ab} WHEN {_SWAP} AND g_shape = 5 THEN {cd} ELSE {plain} END"

#: CTEs dug (digits of both sides) and made (one row a document and side, with what is true of its formula).
MADE = f"""nums AS (SELECT doc_id, lang, source, text, side, (doc_id * {FACTOR} + 11) % {PRIME} AS h, CASE side WHEN 'r' THEN doc_id % 3 ELSE 0 END AS style FROM documents, (VALUES ('r'), ('p')) s(side)),
 raw AS (SELECT *, {_RAW} FROM nums),
 dug AS (SELECT doc_id, lang, source, text, side, style, g_shape AS shape, CASE WHEN side = 'p' AND doc_id % 5 = 3 THEN (g_o1 + 1) % 4 ELSE g_o1 END AS o1, {_two_ways("g_o2", "g_o2", "g_o3")} AS o2, {_two_ways("g_o3", "g_o3", "g_o2")} AS o3,
   CASE WHEN side = 'p' AND doc_id % 5 = 2 THEN (g_a + 1) % 7 ELSE {_two_ways("g_a", "g_b", "g_c")} END AS a, {_two_ways("g_b", "g_a", "g_d")} AS b, {_two_ways("g_c", "g_c", "g_a")} AS c, {_two_ways("g_d", "g_d", "g_b")} AS d,
   {_two_ways(_N[0], _N[1], _N[2])} AS na, {_two_ways(_N[1], _N[0], _N[3])} AS nb, {_two_ways(_N[2], _N[2], _N[0])} AS nc, {_two_ways(_N[3], _N[3], _N[1])} AS nd FROM raw),
 made AS MATERIALIZED (SELECT *, shape NOT IN (6, 7) AND NOT (side = 'p' AND doc_id % 5 = 4) AS valid, {_styled(lambda s, o, g: text_sql(_leaf(s), s, o, g))} || CASE WHEN side = 'p' AND doc_id % 5 = 4 THEN ' ∧' ELSE '' END AS formula,
   {text_sql(_leaf("¬"), "¬", OPS, "' '")} AS plain, {_NAMES} AS atoms, {SEEN} AS seen, {CONNECTORS} AS conn, CASE WHEN shape = 0 THEN CASE WHEN na = 1 THEN '¬' END ELSE {_pick(OPS, "o1")} END AS main, {_canonical()} AS canon, {_WHOLE} AS whole FROM dug)"""
#: CTE sig: the truth table of each valid formula over all of ATOMS.
SIG = f"sig AS (SELECT doc_id, side, string_agg(CASE WHEN {VALUE} THEN '1' ELSE '0' END, '' ORDER BY z) AS sig FROM made, range(128) t(z) WHERE valid GROUP BY 1, 2)"
PARTS = f"list_sort(list_distinct(list_filter({_PARTS}, lambda x: x IS NOT NULL)))"
NODES = f"(len({LEAVES}) + len(conn))"
PATTERN = _styled(lambda s, o, g: text_sql(_leaf(s, lambda k: "'X'"), s, o, g))
#: The formula with normalised spaces, the ASCII biconditional split as the plain mode does, and kept.
NORMAL, FIXED = (f"CASE style WHEN 2 THEN {text_sql(_leaf('~'), '~', ops, chr(39) + ' ' + chr(39))} ELSE plain END" for ops in (("&", "|", "->", "< ->"), ASCII))


def _distance() -> str:
    """Tree distance of a document's two formulas, of columns r.* and the kind of prediction."""
    size = lambda k: f"(1 + r.n{k})"
    leaf = lambda x, y: f"(CASE WHEN r.n{x} = r.n{y} THEN (r.{x} <> r.{y})::INT ELSE {size(x)} + {size(y)} END)"
    ways = f"CASE WHEN r.o2 = r.o3 AND r.o2 <> 2 THEN least({leaf('a', 'c')} + {leaf('b', 'd')}, {leaf('a', 'd')} + {leaf('b', 'c')}) ELSE (r.o2 <> r.o3)::INT + {leaf('a', 'c')} + {leaf('b', 'd')} END"
    one = f"CASE WHEN r.o1 <> 2 THEN 0 ELSE 2 * {leaf('a', 'b')} END"
    both = f"CASE WHEN r.o1 <> 2 THEN 0 ELSE 2 * ({ways}) END"
    return f"CASE r.doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN CASE r.shape WHEN 1 THEN {one} WHEN 5 THEN {both} ELSE 0 END WHEN 2 THEN 1 ELSE (r.shape > 0)::INT END"


#: CTEs of one row a document: both formulas and the metrics of the pair.
PAIRS = f"""{MADE}, {SIG}, sub(x, y, lcs) AS (SELECT x, y, max(bits) FROM (SELECT x, y, list_sum(list_transform(range(0, length(x)), lambda i: (z >> i) & 1)) AS bits,
   array_to_string(list_filter(list_transform(range(0, length(x)), lambda i: CASE WHEN (z >> i) & 1 = 1 THEN x[i + 1] ELSE '' END), lambda c: c <> ''), '%') AS s
   FROM (SELECT DISTINCT array_to_string(p.conn, '') AS x, array_to_string(r.conn, '') AS y FROM made r JOIN made p USING (doc_id) WHERE r.side = 'r' AND p.side = 'p' AND r.valid AND p.valid), range(0, 128) g(z) WHERE z < (1 << length(x))) WHERE y LIKE '%' || s || '%' GROUP BY 1, 2),
 scored AS (SELECT r.doc_id, r.lang, r.source, r.formula AS reference, p.formula AS prediction, r.valid AS ref_valid, p.valid, CASE WHEN r.valid AND p.valid THEN sr.sig = sp.sig END AS same,
   trim(regexp_replace(r.formula, '\\s+', ' ', 'g')) = trim(regexp_replace(p.formula, '\\s+', ' ', 'g')) AS exact, CASE WHEN r.valid THEN r.canon ELSE trim(r.formula) END = CASE WHEN p.valid THEN p.canon ELSE trim(p.formula) END AS norm,
   CASE WHEN r.valid AND p.valid THEN len(list_intersect(r.atoms, p.atoms)) ELSE 0 END AS hit, len(r.atoms) AS n_ra, len(p.atoms) AS n_pa, CASE WHEN r.valid THEN len(r.atoms) ELSE 0 END AS ref_atoms, CASE WHEN r.valid THEN len(r.conn) ELSE 0 END AS ref_conn,
   CASE WHEN r.valid THEN r.main END AS ref_main, CASE WHEN p.valid THEN p.main END AS pred_main,
   CASE WHEN NOT (r.valid AND p.valid) THEN 0 WHEN len(r.conn) = 0 THEN (len(p.conn) = 0)::INT ELSE coalesce(sub.lcs, 0) / len(r.conn) END AS acc,
   CASE WHEN NOT (r.valid AND p.valid) THEN 0 ELSE greatest(0, 1 - ({_distance()}) / (len(r.conn) + CASE r.shape WHEN 0 THEN 1 WHEN 5 THEN 4 WHEN 1 THEN 2 WHEN 8 THEN 2 ELSE 3 END)) END AS partial
   FROM made r JOIN made p ON r.doc_id = p.doc_id AND r.side = 'r' AND p.side = 'p' LEFT JOIN sig sr ON sr.doc_id = r.doc_id AND sr.side = 'r' LEFT JOIN sig sp ON sp.doc_id = p.doc_id AND sp.side = 'p'
   LEFT JOIN sub ON sub.x = array_to_string(p.conn, '') AND sub.y = array_to_string(r.conn, '')),
 pairs AS (SELECT *, CASE WHEN hit > 0 THEN 2 * hit / (n_pa + n_ra) ELSE 0 END AS f1 FROM scored)"""
