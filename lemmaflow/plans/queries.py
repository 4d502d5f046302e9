"""Registered queries of the corpus operators over the driver's tables, each with its SQL.

Formulas come from `made`, which also states in SQL what is true of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import logic, metrics, text, vectors
from ..operators import augment, batching, curate, evaluate, packing, vocabulary
from ..schema import CONNECTORS
from ..shipping import ship
from ..sources import files
from . import chains, made

_REF = f"{made.MADE}, f AS (SELECT * FROM made WHERE side = 'r')"

DOC = "lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _formulas(spark, d, *columns: str) -> DataFrame:
    """doc_id, the columns named, and formula, plain and prediction of each document."""
    return made.formulas(_table(spark, d, "documents").select("doc_id", *columns))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# Curation.


@query(f"SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY {DOC} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_keep_first(spark, d):
    docs = _table(spark, d, "documents")
    return curate.keep_first(docs.select("doc_id", "lang", "source", F.lower(text.strip(F.col("text"))).alias("key")).withColumn("key", F.md5(F.col("key").cast("binary"))), F.col("key"), "doc_id").drop("key")


@query(f"""WITH {_REF},
 n AS (SELECT doc_id, len(atoms) AS size, CASE WHEN shape IN (6, 7) THEN 'invalid_syntax' WHEN doc_id % 7 = 0 THEN 'inconsistent_atoms' END AS reason, {DOC} || '|||' || {made.NORMAL} AS key FROM f),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM n WHERE reason IS NULL) WHERE rn = 1),
 c AS (SELECT count(*) AS n, count(*) FILTER (size <= 2) AS t FROM u)
SELECT (SELECT count(*) FROM n) AS total_input, (SELECT count(*) FROM n WHERE reason = 'invalid_syntax') AS invalid_syntax, 0::BIGINT AS unbalanced_parens, (SELECT count(*) FROM n WHERE reason = 'inconsistent_atoms') AS inconsistent_atoms,
 (SELECT count(*) FROM n WHERE reason IS NULL) - c.n AS duplicates_removed, greatest(0, c.t - floor(c.n * 0.4)::BIGINT) AS trivial_filtered, c.n - greatest(0, c.t - floor(c.n * 0.4)::BIGINT) AS total_output,
 round(100.0 * (c.n - greatest(0, c.t - floor(c.n * 0.4)::BIGINT)) / (SELECT count(*) FROM n), 1) AS retention_pct FROM c""")
def cleaning_funnel(spark, d):
    declared = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("z"))).otherwise(F.array(*map(F.lit, made.ATOMS)))
    rows = _formulas(spark, d, "text").select(F.col("doc_id").alias("pos"), F.col("text").alias("nl"), "formula", F.lit("").alias("formula_ascii"), declared.alias("declared_atoms"))
    return curate.funnel(curate.tag_reasons(rows)).withColumn("retention_pct", F.col("retention_pct").cast("double"))


@query(f"""WITH {_REF}, n AS (SELECT doc_id, len(atoms) AS size, {made.NORMAL} AS normal, {DOC} AS nl FROM f WHERE shape NOT IN (6, 7) AND doc_id % 7 <> 0),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nl, normal ORDER BY doc_id) AS rn FROM n) WHERE rn = 1),
 t AS (SELECT *, row_number() OVER (PARTITION BY size <= 2 ORDER BY md5('42|trivial|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM u) SELECT doc_id AS pos, normal AS formula FROM t WHERE size > 2 OR r <= floor(n * 0.4)""")
def clean_route(spark, d):
    """The cleaning step from end to end: its rows, not its counts."""
    declared = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("z"))).otherwise(F.array(*map(F.lit, made.ATOMS)))
    rows = _formulas(spark, d, "text").select(F.col("doc_id").alias("pos"), F.col("text").alias("nl"), "formula", F.lit("").alias("formula_ascii"), declared.alias("declared_atoms"))
    return curate.clean(rows)[0].select("pos", "formula")


@query(f"""WITH {_REF} SELECT doc_id, len(formula) - len(replace(formula, '(', '')) = len(formula) - len(replace(formula, ')', '')) AND
 list_min(list_transform(range(1, len(formula) + 1), lambda i: len(replace(formula[1:i], ')', '')) - len(replace(formula[1:i], '(', '')))) >= 0 AS balanced FROM f""")
def balanced_parens(spark, d):
    return _formulas(spark, d).select("doc_id", text.balanced_parens(F.col("formula")).alias("balanced"))


@query(f"WITH {_REF} SELECT doc_id, valid, CASE WHEN valid THEN array_to_string(atoms, ',') ELSE '' END AS atoms FROM f")
def syntax_check(spark, d):
    return _formulas(spark, d).withColumn("c", logic.checked(F.col("formula"))).select("doc_id", "c.valid", F.array_join("c.atoms", ",").alias("atoms"))


@query("SELECT doc_id, CASE coalesce(length(text), 0) % 4 WHEN 2 THEN 'OK' WHEN 3 THEN 'an operand was due, not →' ELSE 'Formula vacia' END AS message FROM documents")
def formula_messages(spark, d):
    """Messages of null, blank, valid and broken formulas."""
    kind = F.coalesce(F.char_length("text"), F.lit(0)) % 4
    f = F.when(kind == 1, " \t\u2003").when(kind == 2, "p → q").when(kind == 3, "p → → q")
    t = _table(spark, d, "documents").select("doc_id", f.alias("f"))
    return t.select("doc_id", logic.validity(F.col("f"), logic.syntax(F.col("f"))).message.alias("message"))


@query("""WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents), b AS (SELECT doc_id, n % 3 <> n % 2 AND doc_id % 2 = 1 AS bad FROM d)
SELECT doc_id, CASE WHEN bad THEN 'unbalanced_parens' END AS first_check, CASE WHEN bad THEN 'invalid_syntax' END AS later_check FROM b""")
def both_unbalanced(spark, d):
    """Formulas of which neither notation has balanced parentheses, by the strict order of checks and by the established one."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    f = F.concat(F.lit("p ∧ "), F.repeat(F.lit("("), n % 3), F.lit("q"), F.repeat(F.lit(")"), n % 2))
    a = F.concat(F.lit("p"), F.repeat(F.lit(")"), (F.col("doc_id") % 2).cast("int")))
    t = _table(spark, d, "documents").select("doc_id", f.alias("formula"), a.alias("formula_ascii"), F.array(F.lit("p"), F.lit("q")).alias("declared_atoms"))
    strict = curate.tag_reasons(t, strict=True).withColumnRenamed("reason", "first_check").drop("atoms")
    return curate.tag_reasons(strict).select("doc_id", "first_check", F.col("reason").alias("later_check"))


_LIST = lambda x: f"array_to_string({x}, ' ; ')"


@query(f"""WITH {made.MADE} SELECT doc_id, side, valid, CASE WHEN valid THEN 'OK' ELSE 'error' END AS message, CASE WHEN valid THEN {_LIST("atoms")} END AS atoms, CASE WHEN valid THEN {_LIST("conn")} END AS connectors, CASE WHEN valid THEN main END AS main,
 CASE WHEN valid THEN canon ELSE trim(formula) END AS canonical, CASE WHEN valid THEN {_LIST(made.PARTS)} END AS subformulas, CASE WHEN valid THEN {made.NODES} ELSE 0 END::BIGINT AS nodes FROM made""")
def parse_formulas(spark, d):
    """Grammar B over references and predictions: validity, atoms, connectors, main connector, canonical form, subformulas and node count."""
    f = _formulas(spark, d)
    sides = f.select("doc_id", F.lit("r").alias("side"), "formula").union(f.select("doc_id", F.lit("p"), "prediction"))
    p = sides.withColumn("p", logic.parsed_whole(F.col("formula")))
    joined = lambda c: F.array_join(c, " ; ")
    checked = logic.validity(F.col("formula"), F.col("p"))
    return p.select("doc_id", "side", checked.valid.alias("valid"), F.when(checked.message == "OK", "OK").otherwise("error").alias("message"), joined("p.atoms").alias("atoms"), joined("p.connectors").alias("connectors"), "p.main", "p.canonical", joined("p.subs").alias("subformulas"), F.coalesce(logic.node_count(F.col("p.rpn")), F.lit(0)).cast("long").alias("nodes"))


_ROW = "CASE WHEN z & 1 = 1 THEN 'T' ELSE 'F' END"
_CELLS = "array_to_string(list_transform(atoms, lambda x: CASE WHEN (z >> (list_position(['" + "', '".join(made.ATOMS) + "'], x) - 1)) & 1 = 1 THEN 'T' ELSE 'F' END), ' | ')"
_MASK = "list_sum(list_transform(atoms, lambda x: 1 << (list_position(['" + "', '".join(made.ATOMS) + "'], x) - 1)))::BIGINT"


@query(f"""WITH {_REF}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY doc_id) AS rn FROM f WHERE valid) WHERE rn = 1),
 l AS (SELECT formula, atoms, {_CELLS} AS cells, CASE WHEN {made.VALUE} THEN 'T' ELSE 'F' END AS v FROM g, range(128) t(z) WHERE z & ~({_MASK}) = 0)
SELECT formula, any_value(array_to_string(atoms, ' | ') || ' | ' || formula || chr(10) || array_to_string(list_transform(atoms, lambda x: repeat('-', length(x))), '-|-') || '-|-' || repeat('-', length(formula))) || chr(10) ||
 string_agg(cells || ' | ' || repeat(' ', length(formula) // 2) || v, chr(10) ORDER BY cells) AS "table" FROM l GROUP BY formula""")
def printed_truth_tables(spark, d):
    return logic.format_truth_table(_formulas(spark, d).select("formula"))


@query("""WITH d AS (SELECT doc_id, 7 + doc_id % 14 AS k, (doc_id // 14) % 4 AS o, (doc_id // 56) % 3 AS kind FROM documents)
SELECT doc_id, k AS atoms, CASE kind WHEN 0 THEN true WHEN 1 THEN o <> 2 ELSE false END AS equivalent FROM d""")
def equivalence_many_atoms(spark, d):
    """Chains of 7 to 20 atoms against themselves (with a tautology of an atom of their own), their reverse, and themselves without the last one: no number of atoms is too many."""
    k, o, kind = 7 + F.col("doc_id") % 14, F.floor(F.col("doc_id") / 14) % 4, F.floor(F.col("doc_id") / 56) % 3
    sign = F.concat(F.lit(" "), F.get(F.array(*map(F.lit, made.OPS)), o.cast("int")), F.lit(" "))
    chain = F.transform(F.sequence(F.lit(1).cast("long"), k), lambda i: F.concat(F.lit("x"), i.cast("string")))
    other = F.when(kind == 0, F.concat(F.lit("("), F.array_join(chain, "§"), F.lit(") ∧ (y ∨ ¬y)"))).when(kind == 1, F.array_join(F.reverse(chain), "§")).otherwise(F.array_join(F.slice(chain, F.lit(1), (k - 1).cast("int")), "§"))
    t = _table(spark, d, "documents").select("doc_id", k.alias("atoms"), F.replace(F.array_join(chain, "§"), F.lit("§"), sign).alias("a"), F.replace(other, F.lit("§"), sign).alias("b"))
    return t.select("doc_id", F.size(logic.syntax(F.col("a")).atoms).cast("long").alias("atoms"), logic.same_meaning(F.col("a"), F.col("b")).alias("equivalent"))


@query("SELECT doc_id, 20 + 2 * (doc_id % 21) AS atoms, doc_id % 2 = 0 AS equivalent FROM documents")
def equivalence_of_pairs(spark, d):
    """10 to 30 conjunctions of two atoms, all first atoms before all second ones in order of name, against the negation of the implications that deny them; every other one lacks a negation."""
    n = 10 + F.col("doc_id") % 21
    places = F.sequence(F.lit(1).cast("long"), n)
    name = lambda side, i: F.concat(F.lit(side), i.cast("string"))
    one = F.array_join(F.transform(places, lambda i: F.concat(F.lit("("), name("x", i), F.lit(" ∧ "), name("y", i), F.lit(")"))), " ∨ ")
    wrong = lambda i: (F.col("doc_id") % 2 == 1) & (i == n)
    other = F.array_join(F.transform(F.reverse(places), lambda i: F.concat(F.lit("("), name("y", i), F.when(wrong(i), " → ").otherwise(" → ¬"), name("x", i), F.lit(")"))), " ∧ ")
    t = _table(spark, d, "documents").select("doc_id", one.alias("a"), F.concat(F.lit("¬("), other, F.lit(")")).alias("b"))
    return t.select("doc_id", F.size(logic.syntax(F.col("a")).atoms).cast("long").alias("atoms"), logic.same_meaning(F.col("a"), F.col("b")).alias("equivalent"))


@query("""WITH d AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents), l AS (SELECT doc_id, 2 + coalesce(n, 0) AS n, 1 + doc_id % 7 AS k FROM d)
SELECT doc_id, n AS operands, k AS deep, 2 * n - 1 + k AS nodes, least(n, 3) AS atoms, true AS same FROM l""")
def long_formulas(spark, d):
    """As many operands as a document has words, in one chain, behind negations and parentheses; and against itself with some of each more."""
    n, k = 2 + F.coalesce(F.size(F.split("text", " ")), F.lit(0)), (1 + F.col("doc_id") % 7).cast("int")
    atom = lambda i: F.get(F.array(*map(F.lit, "pqr")), (i % 3).cast("int"))
    sign = F.get(F.array(*map(F.lit, (" ∧ ", " ∨ ", " → "))), (F.col("doc_id") % 3).cast("int"))
    chain = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), atom), "§")
    t = _table(spark, d, "documents").select("doc_id", n.cast("long").alias("operands"), k.cast("long").alias("deep"), F.replace(chain, F.lit("§"), sign).alias("f"))
    t = t.withColumns({"a": F.concat(F.repeat(F.lit("¬"), k), F.lit("(("), "f", F.lit("))")), "b": F.concat(F.repeat(F.lit("¬"), k + 2), F.repeat(F.lit("("), k * 300), "f", F.repeat(F.lit(")"), k * 300))})
    s = t.select("doc_id", "operands", "deep", logic.syntax(F.col("a")).alias("p"), logic.same_meaning(F.col("a"), F.col("b")).alias("same"))
    return s.select("doc_id", "operands", "deep", F.size("p.rpn").cast("long").alias("nodes"), F.size("p.atoms").cast("long").alias("atoms"), "same")


@query("SELECT doc_id, CASE WHEN source IN ('simple', 'intermediate', 'advanced') THEN source ELSE lang END AS complexity FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND length(text) >= 20")
def validate_examples(spark, d):
    t = _table(spark, d, "documents")
    return t.where(curate.valid_example(F.col("text"), F.col("lang"), F.col("source"), F.col("text"), 20)).select("doc_id", curate.fix_complexity(F.col("source"), F.col("lang")).alias("complexity"))


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def share_by_group(spark, d):
    return curate.share_by_group(_table(spark, d, "documents").select("lang"), "lang").withColumn("share", F.round("share", 6))


@query("""SELECT doc_id FROM (SELECT doc_id, n_chars < 500 AS t, row_number() OVER (PARTITION BY n_chars < 500 ORDER BY md5('42|trivial|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)
WHERE NOT t OR rn <= floor(n * 0.1)""")
def cap_trivial(spark, d):
    return curate.cap_trivial(_table(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars") < 500, "doc_id", 0.1).select("doc_id")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|balance|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)
WHERE lang = 'es' OR rn <= floor(n * CASE lang WHEN 'en' THEN 0.33 WHEN 'de' THEN 0.10 WHEN 'fr' THEN 0.12 END)""")
def balance_by_class(spark, d):
    return curate.balance(_table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 0.33, "de": 0.10, "fr": 0.12})


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|cap|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= floor(n * 0.04)")
def cap_per_group(spark, d):
    return curate.cap_groups(_table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.04)


@query(f"""WITH {_REF}, p AS (SELECT doc_id, {made.PATTERN} AS g FROM f), g AS (SELECT g, count(*) AS n FROM p GROUP BY 1), r AS (SELECT g, n, sum(n) OVER (ORDER BY md5('42|split|' || g), g) - n AS before, (SELECT count(*) FROM documents) AS total FROM g),
 t AS (SELECT coalesce(sum(n), 0) AS t FROM r WHERE before < floor(total * 0.8))
SELECT doc_id, CASE WHEN before < floor(total * 0.8) THEN 'train' WHEN before - t < floor(total * 0.1) THEN 'val' ELSE 'test' END AS split FROM p JOIN r USING (g), t""")
def group_split(spark, d):
    return curate.pattern_split(_formulas(spark, d).select("doc_id", "formula")).select("doc_id", "split")


@query("""WITH b AS (SELECT * FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('42|balance|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)
 WHERE lang IN ('es') OR lang IS NULL OR rn <= floor(n * CASE lang WHEN 'en' THEN 0.33 WHEN 'de' THEN 0.10 WHEN 'fr' THEN 0.12 END))
SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|cap|' || doc_id), doc_id) AS r, count(*) OVER () AS m FROM b) WHERE r <= floor(m * 0.05)""")
def balance_then_cap(spark, d):
    even = curate.balance(_table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "doc_id", {"en": 0.33, "de": 0.10, "fr": 0.12})
    return curate.cap_groups(even, "source", "doc_id", 0.05)


@query(f"WITH {_REF} SELECT {made.PATTERN} AS pattern, count(*) AS n FROM f GROUP BY 1")
def formula_pattern(spark, d):
    return _formulas(spark, d).groupBy(text.formula_pattern(F.col("formula")).alias("pattern")).agg(F.count("*").alias("n"))


@query(f"WITH {_REF} SELECT doc_id, {made.NORMAL} AS normal, {made.FIXED} AS fixed FROM f")
def normalize_formula(spark, d):
    return _formulas(spark, d).select("doc_id", text.normalize_formula(F.col("formula")).alias("normal"), text.normalize_formula(F.col("formula"), True).alias("fixed"))


@query(f"""WITH {_REF}, c AS (SELECT doc_id, unnest(list_distinct(list_concat(CASE WHEN shape = 6 THEN [{made._pick(made.OPS, "o2")}] ELSE [] END, list_concat(CASE WHEN shape IN (6, 7) THEN list_concat([{made._pick(made.OPS, "o1")}], list_concat(CASE WHEN na = 1 THEN ['¬'] ELSE [] END, CASE WHEN nb = 1 THEN ['¬'] ELSE [] END)) ELSE conn END,
 CASE WHEN style = 2 AND ((shape IN (1, 8) AND o1 = 3) OR (shape IN (2, 3, 4, 6) AND 3 IN (o1, o2)) OR (shape = 5 AND 3 IN (o1, o2, o3)) OR (shape = 7 AND o1 = 3)) THEN ['→'] ELSE [] END)))) AS connector FROM f) SELECT connector, count(*) AS n FROM c GROUP BY 1""")
def connector_profile(spark, d):
    return _formulas(spark, d).select(F.explode(text.connector_profile(F.col("formula"))).alias("connector")).groupBy("connector").agg(F.count("*").alias("n"))


@query(f"WITH {_REF} SELECT len(list_distinct(seen))::BIGINT AS atoms, count(*) AS n FROM f GROUP BY 1")
def atom_histogram(spark, d):
    return _formulas(spark, d).groupBy(text.atom_count(F.col("formula")).cast("long").alias("atoms")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END::BIGINT AS level FROM documents WHERE lang IN ('en', 'de')")
def curriculum_filter(spark, d):
    c = F.when(F.col("lang") == "en", "simple").when(F.col("lang") == "de", "intermediate").otherwise("advanced")
    rows = _table(spark, d, "documents").select("doc_id", c.alias("complexity"), F.array(F.lit(1)).alias("input_ids"))
    return batching.tokenised(rows, max_complexity=1).select("doc_id", F.col("level").cast("long").alias("level"))


@query("SELECT doc_id, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 99 END, doc_id) AS place FROM documents")
def curriculum_sort(spark, d):
    c = F.when(F.col("lang") == "en", "simple").when(F.col("lang") == "de", "intermediate").when(F.col("lang") == "fr", "advanced")
    r = curate.curriculum_rank(_table(spark, d, "documents").select("doc_id", c.alias("complexity")), "complexity", "doc_id")
    return r.select("doc_id", F.col("place").cast("long").alias("place"))


@query("WITH s(t, l) AS (VALUES (0, 0), (5, 1), (15, 2)), e AS (SELECT DISTINCT user_id % 30 AS epoch FROM events) SELECT epoch, max_by(l, t)::BIGINT AS level FROM e JOIN s ON t <= epoch GROUP BY epoch")
def curriculum_schedule_asof(spark, d):
    e = _table(spark, d, "events").select((F.col("user_id") % 30).alias("epoch")).distinct()
    return e.withColumn("level", curate.curriculum_level(F.col("epoch"), curate.parse_schedule("0:0,5:1,15:2")).cast("long"))


@query("SELECT doc_id, least(doc_id // 50, 4)::BIGINT AS block FROM documents")
def block_assignment(spark, d):
    return _table(spark, d, "documents").select("doc_id", curate.block_of(F.col("doc_id"), 50).cast("long").alias("block"))


@query("""SELECT conv_id, turn, '<|bos|><|input|> ' || text || ' <|thought|> ' || role || ' ' || '' || ' <|formula|> ' || turn || '<|eos|>' AS thought, '<|bos|><|input|> ' || text || ' <|formula|> ' || turn || '<|eos|>' AS plain FROM conversations""")
def format_sequence(spark, d):
    t = _table(spark, d, "conversations")
    turn = F.col("turn").cast("string")
    return t.select("conv_id", "turn", text.format_with_thought(F.col("text"), F.array("role", F.lit(None).cast("string")), turn).alias("thought"), text.format_plain(F.col("text"), turn).alias("plain"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS formula FROM documents")
def extract_formula(spark, d):
    s = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<|bos|> x <|formula|> "), "text", F.lit(" <|eos|> rest"))).otherwise(F.concat(F.lit("<|formula|>"), "text"))
    return _table(spark, d, "documents").select("doc_id", text.extract_formula(s).alias("formula"))


@query("SELECT count(*) FILTER (regexp_replace(a.text, '\\s+', ' ', 'g') = regexp_replace(b.text, '\\s+', ' ', 'g')) AS same, count(*) AS n FROM documents a JOIN documents b ON a.doc_id + 1 = b.doc_id")
def exact_match(spark, d):
    t = _table(spark, d, "documents").select("doc_id", F.md5(text.squeeze(F.col("text")).cast("binary")).alias("h"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g"))
    return t.join(b, "doc_id").agg(F.count_if(F.col("h") == F.col("g")).alias("same"), F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k FROM events")
def extract_json(spark, d):
    i = F.col("event_id") % 4
    reply = F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i == 2, F.concat(F.lit("Here: "), "props", F.lit(" done."))).otherwise(F.lit("none"))
    return _table(spark, d, "events").select("event_id", text.extract_json(reply, "k BIGINT").k.alias("k"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    docs, done = _table(spark, d, "documents"), _table(spark, d, "labels")
    return curate.pending(docs.select("doc_id", "lang"), done, F.col("doc_id").cast("string"), F.col("doc_id").cast("string"))


@query("""SELECT doc_id, outcome, CASE outcome WHEN 'corrected' THEN 'fixed' ELSE 'plain' END AS formula FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'api_error' WHEN quality = 1 THEN 'verified' WHEN toxic = 1 AND d.doc_id % 10 >= 3 THEN 'corrected' ELSE 'rejected' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id))""")
def verdict_route(spark, d):
    docs, lab = _table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels")
    v = F.when(F.col("quality").isNotNull(), F.struct((F.col("quality") == 1).alias("is_correct"), F.when(F.col("quality") == 0, 0.4 + (F.col("doc_id") % 10) / 10.0).alias("confidence"), F.when(F.col("toxic") == 1, "fixed").alias("corrected_formula")))
    return curate.route_verdicts(docs.join(lab, "doc_id", "left").withColumn("formula", F.lit("plain")), v).select("doc_id", "outcome", "formula")


# Logic.


@query(f"""WITH {_REF}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY formula) AS docs FROM f WHERE valid) WHERE rn = 1)
SELECT formula, {", ".join(f"CASE WHEN list_contains(atoms, '{x}') THEN (z >> {i}) & 1 = 1 END AS {x}" for i, x in enumerate(made.ATOMS))}, {made.VALUE} AS value, docs FROM g, range(128) t(z) WHERE z & ~({_MASK}) = 0""")
def truth_table_rows(spark, d):
    n = _formulas(spark, d).groupBy("formula").agg(F.count("*").alias("docs"))
    t = logic.truth_table(n)
    return t.select("formula", *[F.try_element_at("assignment", F.lit(a)).alias(a) for a in made.ATOMS], "value", "docs")


@query(f"WITH {made.PAIRS} SELECT doc_id, same AS equivalent, same AS by_table FROM pairs")
def semantic_equivalence(spark, d):
    """By signature, and by truth tables over the union of both formulas' atoms in built-in expressions."""
    f = _formulas(spark, d).withColumns({"r": logic.syntax(F.col("formula")), "p": logic.syntax(F.col("prediction"))})
    none = F.array().cast("array<string>")
    f = f.withColumn("atoms", F.array_sort(F.array_union(F.coalesce("r.atoms", none), F.coalesce("p.atoms", none))))
    table = F.when(F.col("r.valid") & F.col("p.valid"), logic.truth_words(F.col("r.rpn"), F.col("atoms")) == logic.truth_words(F.col("p.rpn"), F.col("atoms")))
    return f.select("doc_id", logic.same_meaning(F.col("prediction"), F.col("formula")).alias("equivalent"), table.alias("by_table"))


def _pairs(spark, d) -> DataFrame:
    return metrics.evaluate_pairs(_formulas(spark, d, "lang", "source").select("doc_id", "lang", "source", "prediction", F.col("formula").alias("reference")))


@query(f"WITH {made.PAIRS} SELECT doc_id, round(CASE WHEN ref_valid AND valid THEN hit / n_pa ELSE 0 END, 6) AS prec, round(CASE WHEN ref_valid AND valid THEN hit / n_ra ELSE 0 END, 6) AS rec, round(f1, 6) AS f1 FROM pairs")
def atom_set_f1(spark, d):
    return _pairs(spark, d).select("doc_id", F.round("atom_precision", 6).alias("prec"), F.round("atom_recall", 6).alias("rec"), F.round("atom_f1", 6).alias("f1"))


@query(f"WITH {made.PAIRS} SELECT doc_id, round(acc, 6) AS accuracy FROM pairs")
def lcs_accuracy(spark, d):
    return _pairs(spark, d).select("doc_id", F.round("connector_accuracy", 6).alias("accuracy"))


@query(f"""WITH {made.PAIRS} SELECT doc_id, exact, same, norm, valid, round(partial, 6) AS partial, round((f1 + (ref_valid AND valid AND ref_main IS NOT DISTINCT FROM pred_main)::INT + coalesce(same, false)::INT) / 3, 6) AS three,
 CASE WHEN NOT valid THEN 'syntax' WHEN NOT coalesce(same, true) AND partial > 0.7 THEN 'near_miss' WHEN NOT coalesce(same, true) THEN 'semantic' END AS error FROM pairs""")
def pair_metrics(spark, d):
    """Exact, semantic and normalised match, validity, partial credit, the mean of three compositional parts, and the class of error."""
    p = _pairs(spark, d)
    three = (F.col("comp_atoms") + F.col("comp_connector") + F.col("comp_full")) / 3
    error = evaluate.error_class(F.col("valid_syntax"), F.col("semantic_match"), F.col("partial_credit"))
    return p.select("doc_id", F.col("exact_match").alias("exact"), F.col("semantic_match").alias("same"), F.col("normalized_match").alias("norm"), F.col("valid_syntax").alias("valid"), F.round("partial_credit", 6).alias("partial"), F.round(three, 6).alias("three"), error.alias("error"))


@query()
def subformula_scores(spark, d):
    """Share of subformulas with an equivalent partner, and the compositional mean; tests hold them against a naive matcher."""
    return _pairs(spark, d).select("doc_id", "comp_subformulas", "compositional")


@query(f"""WITH {made.PAIRS}, e AS (SELECT doc_id, CASE WHEN NOT valid THEN 'syntax' WHEN NOT coalesce(same, true) AND partial > 0.7 THEN 'near_miss' WHEN NOT coalesce(same, true) THEN 'semantic' END AS error_class FROM pairs)
SELECT error_class, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY error_class ORDER BY doc_id) AS rank FROM e WHERE error_class IS NOT NULL) WHERE rank <= 5""")
def error_examples(spark, d):
    """The first five errors of each class (a report's limit)."""
    return evaluate.error_examples(_pairs(spark, d), "doc_id").select("error_class", "doc_id", F.col("rank").cast("long").alias("rank"))


_BATCH = """count(*) AS n_total, count(*) FILTER (valid) AS n_valid, count(same) AS n_evaluable, avg(exact::INT) AS exact_match, coalesce(avg(same::INT), 0) AS semantic_accuracy, avg(coalesce(same, false)::INT) AS semantic_accuracy_total,
 avg(norm::INT) AS normalized_match, avg(valid::INT) AS valid_syntax_rate, avg(f1) AS atom_f1, avg(acc) AS connector_accuracy, avg(partial) AS partial_credit, avg((ref_valid AND valid AND ref_main IS NOT DISTINCT FROM pred_main)::INT) AS comp_connector"""


@query(f"""WITH {made.PAIRS}, m AS (SELECT {_BATCH} FROM pairs) SELECT n_total, n_valid, n_evaluable, {", ".join(f"round({c}, 6) AS {c}" for c in ("exact_match", "semantic_accuracy", "semantic_accuracy_total", "normalized_match", "valid_syntax_rate", "atom_f1", "connector_accuracy", "partial_credit", "comp_connector"))},
 CASE WHEN valid_syntax_rate < 0.8 THEN 'syntax' WHEN atom_f1 < 0.8 THEN 'atoms' WHEN connector_accuracy < 0.8 THEN 'connectors' WHEN semantic_accuracy < 0.8 THEN 'semantics' ELSE 'good' END AS diagnosis FROM m""")
def batch_metrics(spark, d):
    m = evaluate.diagnose_batch(evaluate.batch_metrics(_pairs(spark, d)))
    return m.select("n_total", "n_valid", "n_evaluable", *[F.round(c, 6).alias(c) for c in ("exact_match", "semantic_accuracy", "semantic_accuracy_total", "normalized_match", "valid_syntax_rate", "atom_f1", "connector_accuracy", "partial_credit", "comp_connector")], "diagnosis")


_LENGTH = "CASE WHEN ref_conn <= 2 THEN '1-2 conectores' WHEN ref_conn <= 4 THEN '3-4 conectores' ELSE '5+ conectores' END"
_GROUPED = " UNION ALL ".join(
    f"SELECT '{dim}' AS dimension, {key} AS category, count(*) AS total, round(avg(exact::INT), 4) AS exact_match, round(avg(coalesce(same, false)::INT), 4) AS semantic_accuracy, round(avg(norm::INT), 4) AS normalized_match, round(avg(valid::INT), 4) AS valid_syntax, round(avg(f1), 4) AS atom_f1, round(avg(acc), 4) AS connector_accuracy, round(avg(partial), 4) AS partial_credit FROM pairs WHERE {key} IS NOT NULL GROUP BY {key}"
    for dim, key in (("global", "'all'"), ("complexity", "lower(lang)"), ("block", "lower(source)"), ("connector", "ref_main"), ("length", _LENGTH), ("atoms", "ref_atoms || ' átomos'"))
)


@query(f"WITH {made.PAIRS} {_GROUPED}")
def benchmark_grouping_sets(spark, d):
    return evaluate.breakdown(_pairs(spark, d), "lang", "source").drop("compositional")


_RANKED = f"""parts AS ({_GROUPED}), placed AS (SELECT *, row_number() OVER (ORDER BY list_position(['global', 'complexity', 'connector', 'block', 'length', 'atoms'], dimension),
 CASE WHEN dimension = 'length' THEN list_position(['1-2 conectores', '3-4 conectores', '5+ conectores'], category) ELSE 0 END, CASE WHEN dimension IN ('connector', 'block') THEN -semantic_accuracy ELSE 0 END, category) AS place FROM parts)"""


@query(f"WITH {made.PAIRS}, {_RANKED} SELECT place, dimension, CASE WHEN dimension = 'global' THEN 'Global' WHEN dimension IN ('complexity', 'block') THEN upper(category[1]) || category[2:] ELSE category END AS label, total, semantic_accuracy FROM placed")
def report_order(spark, d):
    """The report's rows in the order in which it prints them (the languages, which stand for complexities, are not among its named ones: by name)."""
    r = evaluate.report_rows(evaluate.breakdown(_pairs(spark, d), "lang", "source"))
    return r.select(F.col("place").cast("long").alias("place"), "dimension", "label", "total", "semantic_accuracy")


@query(f"""WITH {made.PAIRS} SELECT (SELECT count(*) FROM pairs)::BIGINT AS total, (SELECT count(DISTINCT lower(lang)) FROM pairs) AS complexities, (SELECT count(DISTINCT lower(source)) FROM pairs) AS blocks, (SELECT count(DISTINCT ref_main) FROM pairs) AS connectors,
 (SELECT count(DISTINCT {_LENGTH}) FROM pairs) AS lengths, (SELECT count(DISTINCT ref_atoms) FROM pairs) AS atoms, (SELECT count(*) FROM pairs WHERE ref_main = '∧' AND pred_main = '∨') AS mixed, (SELECT round(avg(coalesce(same, false)::INT), 4) FROM pairs WHERE ref_main = '→') AS implication""")
def report_document(spark, d):
    """The report as one JSON document, read again."""
    p = _pairs(spark, d)
    doc = evaluate.report_document(evaluate.breakdown(p, "lang", "source"), p)
    entry = "struct<name:string,total:bigint,semantic_accuracy:double>"
    r = doc.select(F.from_json("report", f"total bigint, by_complexity map<string,{entry}>, by_connector map<string,{entry}>, by_block map<string,{entry}>, by_length map<string,{entry}>, by_n_atoms map<string,{entry}>, confusion_matrix map<string,map<string,bigint>>").alias("r"))
    size = lambda c: F.size(f"r.{c}").cast("long")
    mixed = F.coalesce(F.try_element_at(F.try_element_at("r.confusion_matrix", F.lit("∧")), F.lit("∨")), F.lit(0).cast("long"))
    return r.select("r.total", size("by_complexity").alias("complexities"), size("by_block").alias("blocks"), size("by_connector").alias("connectors"), size("by_length").alias("lengths"), size("by_n_atoms").alias("atoms"), mixed.alias("mixed"), F.try_element_at("r.by_connector", F.lit("→")).semantic_accuracy.alias("implication"))


@query(f"WITH {made.PAIRS} SELECT ref_main AS real, " + ", ".join(f"count(*) FILTER (pred_main = '{c}') AS \"{c}\"" for c in CONNECTORS) + " FROM pairs WHERE ref_main IS NOT NULL AND pred_main IS NOT NULL GROUP BY ref_main")
def confusion_matrix(spark, d):
    return evaluate.confusion(_pairs(spark, d))


@query(f"WITH {made.PAIRS} SELECT ref_main AS real, pred_main AS predicted, count(*) AS n FROM pairs WHERE ref_main <> pred_main GROUP BY 1, 2 ORDER BY n DESC, real DESC, predicted DESC LIMIT 5")
def top_confusions(spark, d):
    return evaluate.top_confusions(_pairs(spark, d))


@query(f"""WITH {made.PAIRS}, parts AS ({_GROUPED}), mixed AS (SELECT ref_main, pred_main, count(*) AS n FROM pairs WHERE ref_main <> pred_main GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT 'advanced' AS rule, 'advanced' AS detail FROM parts WHERE dimension = 'complexity' AND category = 'fr' AND semantic_accuracy < 0.5
UNION ALL SELECT 'connector', category FROM parts WHERE dimension = 'connector' AND semantic_accuracy < 0.7 AND total >= 5
UNION ALL SELECT 'atoms', printf('%.4f', a - b) FROM (SELECT min_by(semantic_accuracy, category) AS a, max_by(semantic_accuracy, category) AS b FROM parts WHERE dimension = 'atoms') WHERE a - b > 0.3
UNION ALL SELECT 'confusion', ref_main || ' as ' || pred_main FROM (SELECT * FROM mixed ORDER BY n DESC, ref_main DESC, pred_main DESC LIMIT 1)""")
def diagnosis(spark, d):
    """Languages stand for complexities: `fr` for advanced."""
    p = _pairs(spark, d).withColumn("lang", F.when(F.col("lang") == "fr", "advanced").otherwise(F.col("lang")))
    return evaluate.diagnose(evaluate.breakdown(p, "lang", "source"), p)


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS rn FROM documents), s AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS shown FROM f WHERE rn = 1)
SELECT shown::INT AS shown, doc_id, coalesce(source, '') AS block, left(text, 100) || '...' AS shown_text, strlen(text)::BIGINT AS bytes FROM s WHERE shown <= 3""")
def examples_of_blocks(spark, d):
    """The first example of each of the first three distinct blocks, as a report shows them."""
    rows = _table(spark, d, "documents").select("doc_id", F.col("source").alias("block"), F.concat(F.substring("text", 1, 100), F.lit("...")).alias("shown_text"), F.octet_length("text").cast("long").alias("bytes"))
    return evaluate.first_of_groups(rows, "block", "doc_id")


@query(f"WITH {_REF} SELECT CASE WHEN NOT valid OR len(conn) <= 2 THEN '1-2 conectores' WHEN len(conn) <= 4 THEN '3-4 conectores' ELSE '5+ conectores' END AS bucket, count(*) AS n FROM f GROUP BY 1")
def length_bucket(spark, d):
    p = _formulas(spark, d).withColumn("p", logic.syntax(F.col("formula")))
    return p.groupBy(text.length_bucket(F.coalesce(F.size("p.connectors"), F.lit(0))).alias("bucket")).agg(F.count("*").alias("n"))


# Augmentation.

_A, _B, _C, _D = (made._leaf("¬")(k) for k in "abcd")
_O = [made._pick(made.OPS, o) for o in ("o1", "o2", "o3")]
_PAR = lambda x, o, y: f"'(' || {x} || ' ' || {o} || ' ' || {y} || ')'"
_SWAPPED = f"""CASE WHEN shape IN (2, 4) AND o2 <> 2 THEN CASE shape WHEN 4 THEN '¬' ELSE '' END || {_PAR(_B, _O[1], _A)} || ' ' || {_O[0]} || ' ' || {_C} WHEN shape = 3 AND o2 <> 2 THEN {_A} || ' ' || {_O[0]} || ' ' || {_PAR(_C, _O[1], _B)}
 WHEN shape = 5 AND o2 <> 2 AND (o3 = 2 OR list_position([0, 1, 3], o2) <= list_position([0, 1, 3], o3)) THEN {_PAR(_B, _O[1], _A)} || ' ' || {_O[0]} || ' ' || {_PAR(_C, _O[2], _D)}
 WHEN shape = 5 AND o3 <> 2 THEN {_PAR(_A, _O[1], _B)} || ' ' || {_O[0]} || ' ' || {_PAR(_D, _O[2], _C)} END"""
_DRAW = "('0x' || left(md5('42|double_negation|' || doc_id), 7))::BIGINT"
_TARGET = f"seen[({_DRAW} % greatest(len(seen), 1) + 1)::INT]"
#: Each rewrite of the reference in notation 0, from its digits.
_VARIANTS = f"""v0 AS (SELECT doc_id, plain, unnest([
  {{'kind': 'implication→disjunction', 'f': CASE WHEN contains(plain, '→') AND strpos(plain, '→') > 1 THEN '¬(' || trim(plain[:strpos(plain, '→') - 1]) || ') ∨ (' || trim(plain[strpos(plain, '→') + 1:]) || ')' END}},
  {{'kind': 'de_morgan_and', 'f': CASE WHEN shape = 4 AND o2 = 0 THEN '(¬' || {_A} || ' ∨ ¬' || {_B} || ') ' || {_O[0]} || ' ' || {_C} END}},
  {{'kind': 'de_morgan_or', 'f': CASE WHEN shape = 4 AND o2 = 1 THEN '(¬' || {_A} || ' ∧ ¬' || {_B} || ') ' || {_O[0]} || ' ' || {_C} END}},
  {{'kind': 'double_negation_remove', 'f': CASE WHEN shape = 8 THEN {_A} || ' ' || {_O[0]} || ' ' || {_B} END}},
  {{'kind': 'double_negation_add', 'f': CASE WHEN len(seen) > 0 THEN plain[:strpos(plain, {_TARGET}) - 1] || '¬¬' || plain[strpos(plain, {_TARGET}):] END}},
  {{'kind': 'commutativity', 'f': {_SWAPPED}}}]) AS v FROM f),
 variants AS (SELECT doc_id, v.kind AS kind, v.f AS formula FROM v0 WHERE v.f IS NOT NULL AND v.f <> plain)"""


@query(f"WITH {_REF}, {_VARIANTS} SELECT * FROM variants")
def augment_variants(spark, d):
    """All rewrites of all formulas."""
    f = _formulas(spark, d).select("doc_id", F.col("plain").alias("formula"))
    return augment.variants(f, "doc_id", limit=None).select("doc_id", F.col("augmentation_type").alias("kind"), "formula")


@query(f"WITH {_REF}, {_VARIANTS} SELECT doc_id, kind, formula FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42|variant|' || doc_id || '|' || kind), kind) AS r FROM variants) WHERE r <= 2")
def augment_two(spark, d):
    """At most two rewrites a row, drawn at random."""
    f = _formulas(spark, d).select("doc_id", F.col("plain").alias("formula"))
    return augment.variants(f, "doc_id").select("doc_id", F.col("augmentation_type").alias("kind"), "formula")


@query()
def augment_verified(spark, d):
    """Rewrites that keep the truth; tests evaluate both formulas of each."""
    f = _formulas(spark, d).select("doc_id", F.col("plain").alias("formula"))
    return augment.variants(f, "doc_id", limit=2, verified=True)


@query("""WITH s AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42|compose|' || doc_id), doc_id) - 1 AS r FROM documents WHERE lang IN ('en', 'de')), p AS (SELECT r // 2 AS pair, max(CASE WHEN r % 2 = 0 THEN doc_id END) AS l, max(CASE WHEN r % 2 = 1 THEN doc_id END) AS r FROM s GROUP BY 1)
SELECT pair, l AS left_id, r AS right_id FROM p WHERE l IS NOT NULL AND r IS NOT NULL AND pair < 500 AND pair < (SELECT count(*) // 2 FROM documents)""")
def pair_compose(spark, d):
    c = F.when(F.col("lang") == "en", "simple").when(F.col("lang") == "de", "intermediate").otherwise("advanced")
    p = augment.pairs(_table(spark, d, "documents").select("doc_id", c.alias("complexity")), "doc_id")
    return p.select(F.col("pair").cast("long").alias("pair"), F.col("left.doc_id").alias("left_id"), F.col("right.doc_id").alias("right_id"))


_PAIRED = """s AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42|compose|' || doc_id), doc_id) - 1 AS r FROM documents WHERE lang IN ('en', 'de')), p AS (SELECT r // 2 AS pair, max(CASE WHEN r % 2 = 0 THEN doc_id END) AS l, max(CASE WHEN r % 2 = 1 THEN doc_id END) AS r FROM s GROUP BY 1),
 two AS (SELECT pair, l, r, ('0x' || left(md5('42|cue|' || l || '|' || r), 7))::BIGINT AS draw FROM p WHERE l IS NOT NULL AND r IS NOT NULL AND pair < 500 AND pair < (SELECT count(*) // 2 FROM documents))"""
_CUES_SQL = "[" + ", ".join("[" + ", ".join(f"'{c}'" for c in cues) + "]" for cues in augment.CUES.values()) + "]"
_SIGNS_SQL = "[" + ", ".join(f"'{c}'" for c in augment.CUES) + "]"
_COMPOSED = f"""{_PAIRED}, both_ AS (SELECT pair, draw, a.text AS n1, b.text AS n2, a.plain AS f1, b.plain AS f2, list_sort(list_intersect(list_distinct(a.seen), list_distinct(b.seen))) AS clash, list_filter(string_split('abcdefghijklmnopqrstuvwxy', ''), lambda c: c > coalesce(list_max(a.seen), 'p')) AS pool
   FROM two JOIN f a ON a.doc_id = l JOIN f b ON b.doc_id = two.r),
 named AS (SELECT *, array_to_string(list_transform(range(1, length(f2) + 1), lambda i: CASE WHEN list_contains(clash, f2[i]) AND (i = 1 OR f2[i - 1] <> '¬') THEN pool[list_position(clash, f2[i])] ELSE f2[i] END), '') AS g2 FROM both_ WHERE len(pool) >= len(clash)),
 composed AS (SELECT pair, n1 || '. ' || lower({_CUES_SQL}[(draw % 3 + 1)::INT][((draw // 3) % 3 + 1)::INT]) || lower(n2[1]) || n2[2:] AS nl, '(' || f1 || ') ' || {_SIGNS_SQL}[(draw % 3 + 1)::INT] || ' (' || g2 || ')' AS formula, {_SIGNS_SQL}[(draw % 3 + 1)::INT] AS connector FROM named WHERE length(n1) > 0 AND length(n2) > 0)"""


def _examples(spark, d) -> DataFrame:
    c = F.when(F.col("lang") == "en", "simple").when(F.col("lang") == "de", "intermediate").otherwise("advanced")
    f = _formulas(spark, d, "text", "lang")
    return f.select("doc_id", F.col("text").alias("nl"), F.col("plain").alias("formula"), c.alias("complexity"), F.array(F.lit("x")).alias("steps"), F.array(F.col("lang")).alias("declared_atoms"))


@query(f"WITH {_REF}, {_COMPOSED} SELECT pair, nl, formula, connector, 'Composición de dos proposiciones' AS steps, 2::BIGINT AS n_declared FROM composed")
def compositions(spark, d):
    """New examples of two whole texts each: at most 500 (the operator's own limit)."""
    c = augment.compose(_examples(spark, d), "doc_id")
    return c.select("pair", "nl", "formula", "connector", F.array_join("steps", "|").alias("steps"), F.size("declared_atoms").cast("long").alias("n_declared"))


@query(f"""WITH {_REF}, {_VARIANTS}, {_COMPOSED}, v AS (SELECT kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42|variant|' || doc_id || '|' || kind), kind) AS r FROM variants) WHERE r <= 2)
SELECT kind, count(*) AS n FROM (SELECT NULL AS kind FROM documents UNION ALL SELECT kind FROM v UNION ALL SELECT 'composition' FROM composed) GROUP BY 1""")
def augment_route(spark, d):
    """Originals, rewrites and compositions together, counted by kind."""
    return augment.augment(_examples(spark, d), "doc_id").groupBy(F.col("augmentation_type").alias("kind")).agg(F.count("*").alias("n"))


# Batching.


@query("WITH l AS (SELECT n_chars AS len, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT max(n) AS n, min(len) AS min, max(len) AS max, round(avg(len), 4) AS mean, max(len) FILTER (i = n // 2) AS median, max(len) FILTER (i = floor(n * 0.95)) AS p95, max(len) FILTER (i = floor(n * 0.99)) AS p99 FROM l")
def length_percentiles(spark, d):
    return batching.length_stats(_table(spark, d, "documents"), "n_chars").withColumn("mean", F.round("mean", 4))


@query("""WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY n_chars, md5('42|length|' || doc_id), doc_id) - 1) // 160 AS bucket FROM documents) SELECT doc_id, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY md5('42|bucket|' || doc_id), doc_id) - 1) // 16 AS batch FROM r""")
def length_bucketing(spark, d):
    b = batching.length_buckets(_table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 16)
    return b.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.col("batch").cast("long").alias("batch"))


def _rounds(source: str) -> str:
    """The rounds of batching.permuted (seed 7) in SQL: rows of source (number, epoch, n, h, w, x, turn) with another x."""
    mix = lambda v, k: f"((({v} + (7 * 1000003 + epoch * 7919 + {k} * 104729 + 12345) % 2147483647) * 2654435761) % 4294967296 >> 9)"
    out = f"SELECT *, x // w AS a0, x % w AS b0 FROM {source}"
    for k in range(8):
        new = f"(a{k} + {mix(f'b{k}', k)}) % h AS a{k + 1}, b{k} AS b{k + 1}" if k % 2 == 0 else f"a{k} AS a{k + 1}, (b{k} + {mix(f'a{k}', k)}) % w AS b{k + 1}"
        out = f"SELECT *, {new} FROM ({out})"
    return f"SELECT number, epoch, n, h, w, a8 * w + b8 AS x, turn + 1 AS turn FROM ({out})"


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, (row_number() OVER (ORDER BY n_chars, md5('42|length|' || doc_id), doc_id) - 1) // 160 AS bucket FROM documents),
 b AS (SELECT doc_id, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY md5('42|bucket|' || doc_id), doc_id) - 1) // 16 AS batch FROM r),
 f AS (SELECT *, bucket * 10 + batch AS number FROM b QUALIFY count(*) OVER (PARTITION BY bucket, batch) = 16),
 s AS (SELECT max(number) + 1 AS n, ceil(sqrt(max(number) + 1))::BIGINT AS w FROM f),
 walk AS (SELECT number, epoch, n, (n + w - 1) // w AS h, w, number AS x, 0 AS turn FROM (SELECT DISTINCT number FROM f), (VALUES (0), (1)) e(epoch), s
   UNION ALL {_rounds("walk WHERE turn = 0 OR x >= n")})
SELECT doc_id, epoch::BIGINT AS epoch, x::BIGINT AS step FROM f JOIN (SELECT number, epoch, x FROM walk WHERE turn > 0 AND x < n) USING (number)""")
def shuffled_batches(spark, d):
    """Full batches of rows of like length, in the order of two epochs."""
    b = batching.length_buckets(_table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 16, drop_last=True)
    epochs = [batching.epoch_order(b, 7, e).select("doc_id", F.lit(e).cast("long").alias("epoch"), "step") for e in (0, 1)]
    return epochs[0].unionByName(epochs[1])


_IDS = "list_transform(string_split(text, ' '), lambda x: length(x))"


def _conv_ids(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda x: F.length(x)).alias("ids"))


#: Turns with their bin of next-fit packing into bins of {most}.
_BINS = """t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, {ids}[1:{most}] AS ids FROM conversations), l AS (SELECT *, len(ids) AS n FROM t),
 w AS (SELECT conv_id, i, n, 0 AS bin, n AS used FROM l WHERE i = 1 UNION ALL SELECT l.conv_id, l.i, l.n, CASE WHEN w.used > 0 AND w.used + l.n > {most} THEN w.bin + 1 ELSE w.bin END, CASE WHEN w.used > 0 AND w.used + l.n > {most} THEN l.n ELSE w.used + l.n END FROM w JOIN l ON l.conv_id = w.conv_id AND l.i = w.i + 1)"""


@query(f"WITH RECURSIVE {_BINS.format(ids=_IDS, most=128)} SELECT conv_id, bin::BIGINT AS bin, count(*) AS n_docs, sum(n)::BIGINT AS n_real_tokens FROM w GROUP BY 1, 2")
def pack_next_fit(spark, d):
    p = batching.pack(_conv_ids(spark, d), F.col("conv_id"), "turn", "ids", 128)
    return p.select(F.col("shard").alias("conv_id"), F.col("bin").cast("long").alias("bin"), F.col("n_docs").cast("long").alias("n_docs"), F.col("n_real_tokens").cast("long").alias("n_real_tokens"))


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn // 2 AS doc FROM conversations) SELECT a.conv_id AS seq, a.pos AS i, b.pos AS j FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.doc = b.doc AND b.pos <= a.pos""")
def document_mask_pairs(spark, d):
    t = _table(spark, d, "conversations").select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("pos"), F.floor(F.col("turn") / 2).alias("doc"))
    return batching.mask_pairs(t, "conv_id", "pos", "doc")


@query(f"""WITH t AS (SELECT conv_id, turn, {_IDS} AS ids FROM conversations), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS m FROM t)
SELECT conv_id, turn, array_to_string(list_transform(range(1, m + 1), lambda i: coalesce(ids[i], 0)), ',') AS padded, array_to_string(list_transform(range(1, m + 1), lambda i: coalesce(ids[i + 1], -100)), ',') AS targets, array_to_string(list_transform(range(1, m + 1), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ',') AS attention FROM m""")
def dynamic_padding(spark, d):
    p = batching.padded(_conv_ids(spark, d), ["conv_id"], "ids")
    return p.select("conv_id", "turn", *[F.array_join(c, ",").alias(c) for c in ("padded", "targets", "attention")])


@query(f"""WITH RECURSIVE {_BINS.format(ids=_IDS, most=64)}, u AS (SELECT w.conv_id, w.bin, w.i AS doc, unnest(l.ids) AS x, generate_subscripts(l.ids, 1) AS k FROM w JOIN l USING (conv_id, i)),
 p AS (SELECT *, row_number() OVER q AS place, lead(x) OVER q AS nx, lead(doc) OVER q AS nd FROM u WINDOW q AS (PARTITION BY conv_id, bin ORDER BY doc, k)), b AS (SELECT DISTINCT conv_id, bin FROM w)
SELECT b.conv_id, b.bin::BIGINT AS bin, string_agg(CASE WHEN p.place IS NULL THEN -100 WHEN g.place = 64 THEN 0 WHEN nd = doc THEN nx ELSE -100 END::VARCHAR, ',' ORDER BY g.place) AS targets FROM b JOIN range(1, 65) g(place) ON true LEFT JOIN p ON p.conv_id = b.conv_id AND p.bin = b.bin AND p.place = g.place GROUP BY 1, 2""")
def packed_targets(spark, d):
    """All places of all bins, pad places and the last place of full bins too."""
    p = batching.pack(_conv_ids(spark, d), F.col("conv_id"), "turn", "ids", 64)
    return p.select(F.col("shard").alias("conv_id"), F.col("bin").cast("long").alias("bin"), F.array_join(batching.packed_targets(F.col("input_ids"), F.col("doc_ids")), ",").alias("targets"))


@query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS k, least(len({_IDS}), 96) AS n FROM conversations), r AS (SELECT *, (row_number() OVER (ORDER BY n, md5('42|length|' || k), k) - 1) // 80 AS bucket FROM t), b AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY md5('42|bucket|' || k), k) - 1) // 8 AS batch FROM r)
SELECT bucket, batch, count(*) AS n_rows, max(n)::BIGINT AS width, sum(n)::BIGINT AS n_real FROM b GROUP BY 1, 2""")
def batch_loader(spark, d):
    """A loader's batches: truncated, bucketed by length, padded."""
    t = _conv_ids(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "ids", F.lit("simple").alias("complexity"))
    b = batching.batches(t, "k", "ids", 8, 96)
    real = F.aggregate("attention", F.lit(0), lambda x, y: x + y)
    return b.groupBy(F.col("bucket").cast("long").alias("bucket"), F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n_rows"), F.max(F.size("padded")).cast("long").alias("width"), F.sum(real).alias("n_real"))


@query(f"""WITH RECURSIVE r AS (SELECT conv_id * 1000 + turn AS k, least(len({_IDS}), 128) AS n, row_number() OVER (ORDER BY md5('42|pack|' || (conv_id * 1000 + turn)), conv_id * 1000 + turn) AS rank FROM conversations),
 l AS (SELECT (rank - 1) // 64 AS shard, (rank - 1) % 64 + 1 AS i, n FROM r), w AS (SELECT shard, i, n, 0 AS bin, n AS used FROM l WHERE i = 1
 UNION ALL SELECT l.shard, l.i, l.n, CASE WHEN w.used > 0 AND w.used + l.n > 128 THEN w.bin + 1 ELSE w.bin END, CASE WHEN w.used > 0 AND w.used + l.n > 128 THEN l.n ELSE w.used + l.n END FROM w JOIN l ON l.shard = w.shard AND l.i = w.i + 1)
SELECT shard, bin::BIGINT AS bin, count(*) AS n_docs, sum(n)::BIGINT AS n_real_tokens FROM w GROUP BY 1, 2""")
def shuffled_packing(spark, d):
    """A loader that shuffles sequences and packs them by shards of 64."""
    t = _conv_ids(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "ids", F.lit("simple").alias("complexity"))
    b = batching.batches(t, "k", "ids", 8, 128, packing=True, shard_rows=64)
    return b.select("shard", F.col("bin").cast("long").alias("bin"), F.col("n_docs").cast("long").alias("n_docs"), F.col("n_real_tokens").cast("long").alias("n_real_tokens"))


#: Turns in one order with their bin of next-fit packing into bins of 128.
_ONE_ORDER = """r AS (SELECT {ids}[1:128] AS ids, row_number() OVER (ORDER BY {order}) AS i FROM conversations), l AS (SELECT *, len(ids) AS n FROM r),
 w AS (SELECT i, n, 0 AS bin, n AS used FROM l WHERE i = 1 UNION ALL SELECT l.i, l.n, CASE WHEN w.used + l.n > 128 THEN w.bin + 1 ELSE w.bin END, CASE WHEN w.used + l.n > 128 THEN l.n ELSE w.used + l.n END FROM w JOIN l ON l.i = w.i + 1),
 b AS (SELECT bin, min(i) AS lo, count(*) AS n_docs, sum(n)::BIGINT AS n_real_tokens FROM w GROUP BY bin),
 s AS (SELECT w.bin, string_agg(array_to_string(l.ids, ','), ',' ORDER BY w.i) AS ids, string_agg(array_to_string(list_transform(l.ids, lambda x: w.i - b.lo), ','), ',' ORDER BY w.i) AS docs FROM w JOIN l USING (i) JOIN b ON b.bin = w.bin WHERE l.n > 0 GROUP BY w.bin)
SELECT b.bin::BIGINT AS bin, n_docs, n_real_tokens, md5(ids || repeat(',0', 128 - n_real_tokens::INT)) AS input_ids, md5(docs || repeat(',-1', 128 - n_real_tokens::INT)) AS doc_ids FROM b JOIN s ON s.bin = b.bin"""


def _bins(p):
    return p.select("bin", "n_docs", F.col("n_real_tokens").cast("long").alias("n_real_tokens"), *[F.md5(F.array_join(c, ",").cast("binary")).alias(c) for c in ("input_ids", "doc_ids")])


@query(f"WITH RECURSIVE {_ONE_ORDER.format(ids=_IDS, order='conv_id, turn')}")
def pack_one_order(spark, d):
    """All turns packed in one pass's bins, over ranges of few tokens so that many of them are composed."""
    return _bins(packing.pack_all(_conv_ids(spark, d), ["conv_id", "turn"], "ids", 128, tokens=1024, fan=8))


@query(f"WITH RECURSIVE {_ONE_ORDER.format(ids=_IDS, order='md5(' + chr(39) + '42|pack|' + chr(39) + ' || (conv_id * 1000 + turn)), conv_id * 1000 + turn')}")
def pack_one_shuffle(spark, d):
    """A loader that shuffles all sequences and packs them in one pass's bins."""
    t = _conv_ids(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "ids", F.lit("simple").alias("complexity"))
    return _bins(batching.batches(t, "k", "ids", 8, 128, packing=True, shard_rows=None))


@query("SELECT i, j FROM range(0, 64) a(i), range(0, 64) b(j) WHERE j <= i")
def causal_mask(spark, d):
    return batching.causal_mask(spark, 64)


@query("SELECT pos, k::BIGINT AS k, round(cos(pos / pow(10000.0, 2 * k / 16.0)), 6) AS cos, round(sin(pos / pow(10000.0, 2 * k / 16.0)), 6) AS sin FROM range(0, 32) a(pos), range(0, 8) b(k)")
def rope_table(spark, d):
    return batching.rope_table(spark, 32, 16).select("pos", F.col("k").cast("long").alias("k"), F.round("cos", 6).alias("cos"), F.round("sin", 6).alias("sin"))


# Vocabulary.


#: Words of the byte-level split in RE2, which has no lookahead: a mark is put before the last white space in front of a word first.
_WORDS_SQL = r"""x AS (SELECT unnest(string_split(regexp_replace(nfc_normalize(text), '(\s)(\s\S)', '\1' || chr(1) || '\2', 'g'), chr(1))) AS piece FROM {table}),
 w AS (SELECT unnest(regexp_extract_all(piece, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+')) AS word FROM x), n AS (SELECT hex(word) AS h, count(*) AS n FROM w WHERE word <> '' GROUP BY 1)"""


@query(f"""WITH {_WORDS_SQL.format(table="documents")} SELECT h[2 * i + 1 : 2 * i + 2] AS "left", h[2 * i + 3 : 2 * i + 4] AS "right", sum(n)::BIGINT AS n FROM (SELECT h, n, unnest(range(0, length(h) // 2 - 1)) AS i FROM n) GROUP BY 1, 2""")
def bpe_pair_counts(spark, d):
    """Pairs of adjacent bytes over all words of all documents."""
    w = vocabulary.word_counts(_table(spark, d, "documents").select("text"), "text")
    return vocabulary.pair_counts(w.select(vocabulary.symbols(F.col("word")).alias("parts"), "n"))


#: Special tokens, bytes and merges of the reference's vocabulary.
VOCABULARY_SIZE = 8000


def _trained(spark, d) -> vocabulary.Vocabulary:
    return vocabulary.Vocabulary(vocabulary.train(_table(spark, d, "conversations").select("text"), "text", VOCABULARY_SIZE - 256 - 10))


@query()
def bpe_train(spark, d):
    """All merges of a vocabulary of 8,000 over the conversations, and each one's token id."""
    v = _trained(spark, d)
    return spark.createDataFrame([(i, a, b, v.id_of(a + b)) for i, (a, b) in enumerate(v.merges)], "rank long, left string, right string, id long")


#: Merges that SQL makes too, one after the other.
FIRST_MERGES = 16


def _first_merges_sql() -> str:
    """Words as text `<74><68>`; each step counts all pairs anew and replaces the best one."""
    steps = [f"WITH {_WORDS_SQL.format(table='documents')}", "w0 AS (SELECT regexp_replace(h, '(..)', '<\\1>', 'g') AS s, n FROM n)"]
    for k in range(FIRST_MERGES):
        steps.append(f"""l{k} AS (SELECT string_split(s[2:-2], '><') AS l, n FROM w{k}), p{k} AS MATERIALIZED (SELECT l[i] AS "left", l[i + 1] AS "right", sum(n)::BIGINT AS n FROM (SELECT l, n, unnest(range(1, len(l))) AS i FROM l{k}) GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1)""")
        steps.append(f"""w{k + 1} AS MATERIALIZED (SELECT replace(s, '<' || "left" || '><' || "right" || '>', '<' || "left" || "right" || '>') AS s, w{k}.n FROM w{k}, p{k})""")
    return ",\n ".join(steps) + "\n" + " UNION ALL ".join(f'SELECT {k}::BIGINT AS rank, "left", "right" FROM p{k}' for k in range(FIRST_MERGES))


@query(_first_merges_sql())
def bpe_first_merges(spark, d):
    """The first merges over all documents."""
    merges = vocabulary.train(_table(spark, d, "documents").select("text"), "text", FIRST_MERGES)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank long, left string, right string")


@query("SELECT conv_id, turn, md5(nfc_normalize(text)) AS decoded FROM conversations")
def bpe_round_trip(spark, d):
    """Texts encoded and decoded with a vocabulary trained on them, written and read in between."""
    path = files.work_folder(spark)
    files.write_vocabulary(spark, _trained(spark, d).merges, path)
    v = vocabulary.Vocabulary(files.read_vocabulary(spark, path))
    coded = vocabulary.encode_column(_table(spark, d, "conversations").select("conv_id", "turn", "text"), v, "text")
    return vocabulary.decode_column(coded, v, "input_ids").select("conv_id", "turn", F.md5(F.col("decoded").cast("binary")).alias("decoded"))


# Vectors.


@query("WITH s AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding) + 1e-6) AS r FROM embeddings) SELECT vec_id, round(list_sum(list_transform(e, lambda x: abs(x::DOUBLE / r))), 4) AS l1, round(r, 4) AS rms FROM s")
def rmsnorm_vectors(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = vectors.rmsnorm(F.col("e"))
    return e.select("vec_id", F.round(vectors.total(F.transform(n, F.abs)), 4).alias("l1"), F.round(F.sqrt(vectors.total(F.transform("e", lambda x: x * x)) / F.size("e") + 1e-6), 4).alias("rms"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(ln(list_sum(list_transform(e, lambda x: exp(x)))), 5) AS lse, round(list_max(list_transform(e, lambda x: exp(x))) / list_sum(list_transform(e, lambda x: exp(x))), 5) AS p_max, round(list_max(list_transform(e, lambda x: 0.5 * tanh(x / 0.5))), 5) AS capped FROM e")
def logit_functions(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.round(vectors.logsumexp(F.col("e")), 5).alias("lse"), F.round(F.array_max(vectors.softmax(F.col("e"))), 5).alias("p_max"), F.round(F.array_max(vectors.soft_cap(F.col("e"), 0.5)), 5).alias("capped"))


@query("SELECT vec_id, i - 1 AS place, round(x, 5) AS value FROM (SELECT vec_id, unnest(list_reverse_sort(list_transform(embedding, lambda x: x::DOUBLE))[1:3]) AS x, unnest([1, 2, 3])::BIGINT AS i FROM embeddings)")
def top_k_logits(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.top_k(F.col("embedding").cast("array<double>"), 3)).alias("place", "t"))
    return e.select("vec_id", F.col("place").cast("long").alias("place"), F.round("t.value", 5).alias("value"))


# Scans and sinks.


@query("SELECT count(*) AS n, count(*) FILTER (regexp_matches(text, '\\S')) AS full_lines FROM documents")
def count_examples(spark, d):
    return _table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"(?U)\S")).alias("full_lines"))


@query("SELECT doc_id AS pos, text AS nl, lang AS complexity, source AS block FROM documents")
def json_round_trip(spark, d):
    """Examples written as one JSON document and read again."""
    t = _table(spark, d, "documents")
    path = files.work_folder(spark)
    rows = t.select(F.col("text").alias("natural_language_input"), F.col("lang").alias("complexity"), F.col("source").alias("block"), F.struct(F.lit("p").alias("formula"), F.col("doc_id").cast("string").alias("formula_ascii")).alias("output"), "doc_id")
    files.write_document(rows, t.agg(F.count("*").alias("total_output")), path, "doc_id", stats_key="cleaning_stats")
    e = files.read_examples(spark, path, joined=True)
    return e.select(F.col("output.formula_ascii").cast("long").alias("pos"), F.col("natural_language_input").alias("nl"), "complexity", "block")


@query("SELECT doc_id, lang, text AS sequence, 1::BIGINT AS n FROM documents")
def split_files_round_trip(spark, d):
    """Splits written as JSON lines, one folder each, and read again by the reader of processed records."""
    path = files.work_folder(spark)
    files.write_splits(_table(spark, d, "documents").select(F.col("text").alias("sequence"), F.col("lang").alias("complexity"), F.col("doc_id").cast("string").alias("block"), F.when(F.col("doc_id") % 10 < 8, "train").otherwise("val").alias("split")), path)
    both = files.read_processed(spark, f"{path}/split=train").union(files.read_processed(spark, f"{path}/split=val"))
    return both.groupBy(F.col("block").cast("long").alias("doc_id"), F.col("complexity").alias("lang"), "sequence").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM documents) AS n_lines, conv_id, turn, text AS sequence FROM conversations")
def corpus_file(spark, d):
    """Lines of a file counted, and the sequences of a corpus file read."""
    path, other = files.work_folder(spark), files.work_folder(spark)
    _table(spark, d, "documents").select("doc_id").write.json(path)
    _table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("sequence")).write.json(other)
    rows = files.read_corpus(spark, other)
    n = files.count_examples(spark, path).select(F.col("n").alias("n_lines"))
    named = _table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("h"))
    return named.join(rows.select("sequence", F.md5(F.col("sequence").cast("binary")).alias("h")).distinct(), "h").crossJoin(F.broadcast(n)).select("n_lines", "conv_id", "turn", "sequence")


@query("SELECT page_id, NOT (list_has_any(string_split(url, '/'), ['tag', 'data', 'cache']) OR url LIKE '%.html' OR url LIKE '%7') AS packed FROM pages")
def archive_filter(spark, d):
    """Paths that an archive takes."""
    return _table(spark, d, "pages").select("page_id", files.packable_column(F.col("url"), {"tag", "data", "cache"}, (".html", "7")).alias("packed"))


@query("SELECT doc_id, upper(lang) || '-' || source AS reply FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def generate_replies(spark, d):
    """A generator called for each request."""
    requests = _table(spark, d, "documents").where("lang is not null and source is not null").select("doc_id", "lang", "source")
    return files.generate(requests, _echo).select("doc_id", "reply")


@query("""SELECT doc_id, CASE WHEN k < 3 THEN coalesce(lang, '') || ':' || k END AS reply, least(k + 1, 3)::INT AS tries, [0.0, 1.0, 3.0][least(k, 2) + 1]::DOUBLE AS waited, CASE WHEN k >= 3 THEN 'unavailable 2' END AS failure
FROM (SELECT doc_id, lang, (coalesce(length(text), 0) % 5)::INT AS k FROM documents)""")
def generate_with_failures(spark, d):
    """A generator whose first calls fail, as many as the text's length modulo 5; the clock is not waited for."""
    requests = _table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), (F.coalesce(F.char_length("text"), F.lit(0)) % 5).alias("k"))
    return files.generate(requests, _unsteady, tries=3, wait=_no_wait).drop("lang", "k")


def _unsteady(request: dict, attempt: int) -> str:
    if attempt < request["k"]:
        raise OSError(f"unavailable {attempt}")
    return f"{request['lang']}:{request['k']}"


def _no_wait(seconds: float) -> None:
    """The clock of a test."""


def _echo(request: dict) -> str:
    return f"{request['lang'].upper()}-{request['source']}"


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0")
def resume_from_progress(spark, d):
    """What is pending after two commits of progress were appended and read again."""
    docs = _table(spark, d, "documents").select("doc_id", "lang")
    path = files.work_folder(spark)
    assert files.read_progress(spark, path, "doc_id long").isEmpty()
    for k in (0, 3):
        files.append_checkpoint(docs.where(F.col("doc_id") % 6 == k).select("doc_id"), path)
    done = files.read_progress(spark, path, "doc_id long")
    return curate.pending(docs, done, F.col("doc_id").cast("string"), F.col("doc_id").cast("string"))


@query("""WITH r AS (SELECT i, least(i // 100, 3) AS block, ('0x' || left(md5('42|topic|' || i), 7))::BIGINT AS t, ('0x' || left(md5('42|complexity|' || i), 7))::BIGINT AS c FROM (SELECT range AS i FROM range(500)))
SELECT i AS "index", block::BIGINT AS block, [['a', 'b'], ['c'], ['d', 'e', 'f'], ['g', 'h']][block + 1][(t % len([['a', 'b'], ['c'], ['d', 'e', 'f'], ['g', 'h']][block + 1]) + 1)::INT] AS topic,
 CASE WHEN block = 3 THEN ['intermediate', 'advanced', 'advanced'][(c % 3 + 1)::INT] ELSE ['simple', 'intermediate', 'advanced'][(c % 3 + 1)::INT] END AS complexity FROM r""")
def generation_requests(spark, d):
    r = chains.generation_requests(spark, 500, [["a", "b"], ["c"], ["d", "e", "f"], ["g", "h"]], 100)
    return r.withColumn("block", F.col("block").cast("long"))


@query("SELECT doc_id, source = 'x' AS none, quality = 1 AS is_correct, toxic / 10.0 AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'fenced' ELSE 'plain' END AS kind FROM labels JOIN documents USING (doc_id) WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, NULL, NULL, NULL, 'none' FROM labels WHERE doc_id % 3 = 2")
def parse_verdicts(spark, d):
    """Replies of a judge, with and without a code fence, and some that are no JSON."""
    t = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "source"), "doc_id", "left")
    body = F.to_json(F.struct((F.col("quality") == 1).alias("is_correct"), (F.col("toxic") / 10.0).alias("confidence")))
    reply = F.when(F.col("doc_id") % 3 == 2, "no verdict").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    v = t.withColumn("v", curate.parse_verdicts(reply))
    kind = F.when(F.col("v").isNull(), "none").when(F.col("doc_id") % 2 == 0, "fenced").otherwise("plain")
    return v.select("doc_id", F.when(F.col("v").isNotNull(), F.col("source") == "x").alias("none"), "v.is_correct", F.col("v.confidence"), kind.alias("kind"))


@query("SELECT doc_id, upper(text[1]) || lower(text[2:]) AS capital, md5(nfc_normalize(text)) AS nfc FROM documents")
def text_forms(spark, d):
    t = _table(spark, d, "documents")
    return t.select("doc_id", text.capitalize(F.col("text")).alias("capital"), F.md5(logic.nfc(F.col("text")).cast("binary")).alias("nfc"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    """Extension: the streaming module's window over the table of events."""
    from ..streaming.resume import windowed_counts as run

    return run(_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
