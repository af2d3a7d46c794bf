"""All queries of the core and their SQL, by name. The ids after the double underscore are those of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import assoc, cluster, evaluation, figures, groups, held, inference, pairs, people, postings, probe, ranking, rankstats, resample, sampling, segment, vectors
from scriptoria.plans.lineage import cut, new_path
from scriptoria.sources import corpus, files, markup
from scriptoria.sources.tables import table
from scriptoria.streaming import counts

FLAGSHIP = "probe_delta__R12"
# The seed words of the lexicon.
SEEDS = ["escritura", "escribir", "escrito", "escrita", "ausencia", "ausente", "afuera", "dehors", "errancia", "errar", "muerte", "olvido", "silencio", "soledad", "imposible"]
# The issues in order of appearance.
ISSUES = ["issue_1", "issue_2", "issue_3", "issue_4-5", "issue_6"]
#: Pairs per class, pairs of the graded test, runs of a null, permutations of labels, rows of a filled sample.
N, N_GRADED, RUNS, N_PERM, CAP = probe.N_PAIRS, 200_000, 200, 1_000, 8_000

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def sql() -> dict[str, str]:
    return dict(_SQL)


def _query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        _Q[name] = f
        if sql:
            seen = _needs(ctes)
            _SQL[name] = (("WITH " + ",\n".join(f"{k} AS {'MATERIALIZED ' if k in _ONCE else ''}({_CTE[k]})" for k in seen) + "\n") if seen else "") + sql
        return f

    return add


def _needs(ctes) -> list[str]:
    out: list[str] = []

    def visit(k: str) -> None:
        if k not in out:
            for x in _CTE:
                if x != k and f" {x} " in f" {_CTE[k]} ".replace(")", " ").replace(",", " ").replace("\n", " "):
                    visit(x)
            out.append(k)

    for k in ctes:
        visit(k)
    return out


_B = r"[\p{Z}\t\n\r]"
_ID = lambda x: rf"nullif(regexp_replace(regexp_replace({x}, '^{_B}*#*{_B}*', ''), '{_B}+$', ''), '')"
_TERMS = lambda ws: rf"(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(ws)})($|[^\p{{L}}\p{{N}}_])"
_DOT = "list_dot_product"
#: Parts of the SQL that are used several times and cost much.
_ONCE = {"vec", "gv", "pp", "tok", "pr", "el", "grp", "labelled", "lpair", "lrank", "lperm"}
_CTE = {
    "rec": rf"""SELECT DISTINCT row_id, para_id, regexp_replace(lower(regexp_replace(issue, '^{_B}+|{_B}+$', '', 'g')), ' +', '_', 'g') AS issue, div_id, div_type, text_id, contributor, text,
        list_filter(list_transform(coalesce(persons, []), lambda x: {_ID("x")}), lambda x: x IS NOT NULL) AS persons, ana_gold, has_note FROM paragraphs""",
    "par": "SELECT * FROM rec WHERE length(text) >= 50",
    "lay": rf"""SELECT row_id, list_filter(list_transform(coalesce(lemmas, []), lambda x: trim(regexp_replace(strip_accents(lower(x)), '{_B}+', ' ', 'g'))), lambda x: x IS NOT NULL AND x <> '') AS lemmas FROM concept_layer""",
    "lp": "SELECT DISTINCT row_id, unnest(lemmas) AS item FROM lay",
    "pp": "SELECT DISTINCT row_id, unnest(persons) AS person FROM par",
    "tot": "SELECT count(*) AS n FROM concept_layer",
    "vec": "SELECT vec_id, row_id, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS vec FROM (SELECT vec_id, row_id, embeddings::DOUBLE[] AS e FROM para_vectors WHERE len(embeddings) = 64) WHERE NOT list_contains(list_transform(e, lambda v: isnan(v)), true) AND list_dot_product(e, e) > 0",
    "cited": "SELECT person, row_number() OVER (ORDER BY count(*) DESC, person) AS k FROM pp GROUP BY person",
    "circle": "SELECT person FROM cited WHERE k <= 7",
    "centre": "SELECT person FROM cited WHERE k = 8",
    "grp": f"""SELECT *, NOT (in_a OR in_b OR in_c) AS in_d, in_a AND NOT named AS in_a_s, in_b AND NOT named AS in_b_s FROM (
        SELECT row_id, regexp_matches(text, '{_TERMS(SEEDS)}') AS in_a, row_id IN (SELECT row_id FROM pp SEMI JOIN circle USING (person)) AS in_b,
        row_id IN (SELECT row_id FROM pp SEMI JOIN centre USING (person)) AS in_c,
        coalesce(regexp_matches(text, (SELECT '(?i)(^|[^\\p{{L}}\\p{{N}}_])(' || regexp_extract(person, '[^_]+$') || ')($|[^\\p{{L}}\\p{{N}}_])' FROM centre)), false) AS named FROM par)""",
    "gv": "SELECT g.*, v.vec FROM grp g JOIN vec v USING (row_id)",
    "bag": "SELECT row_id, item, count(*) AS uses FROM (SELECT row_id, unnest(lemmas) AS item FROM lay) GROUP BY ALL",
    "lf": "SELECT item, n_item FROM (SELECT item, count(*) AS n_item FROM lp GROUP BY ALL) WHERE n_item >= 10",
    "pf": "SELECT person, n_group FROM (SELECT person, count(*) AS n_group FROM pp GROUP BY ALL) WHERE n_group >= 5",
    "tfs": """SELECT item, max(n_rows) AS n_rows, round(sum(w / norm), 6) AS score FROM (
        SELECT *, sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS norm FROM (SELECT row_id, item, n_rows, uses * (ln((1.0 + n) / (1 + n_rows)) + 1) AS w FROM bag JOIN (SELECT item, count(*) AS n_rows FROM bag GROUP BY ALL) USING (item), tot)) GROUP BY item""",
    "tfr": "SELECT item, n_rows, score, row_number() OVER (ORDER BY score DESC, item) AS rank FROM tfs",
    "pr": "SELECT p.row_id, p.text_id, v.vec, list_distinct(l.lemmas) AS lemmas, list_distinct(p.persons) AS persons FROM par p JOIN lay l USING (row_id) JOIN (SELECT row_id, vec FROM vec) v USING (row_id)",
    "el": f"""SELECT i, j, round({_DOT}(x, y), 9) AS e_cos, nb / nullif(ni + nj - nb, 0) AS c_jaccard, nb AS shared_lemmas, h AS h_shared FROM (
        SELECT a.row_id AS i, b.row_id AS j, a.vec AS x, b.vec AS y, len(a.lemmas) AS ni, len(b.lemmas) AS nj, len(list_intersect(a.lemmas, b.lemmas)) AS nb, len(list_intersect(a.persons, b.persons)) AS h
        FROM pr a JOIN pr b ON a.row_id % 100 = 0 AND a.row_id <> b.row_id AND a.text_id IS DISTINCT FROM b.text_id AND abs(a.row_id - b.row_id) > 1 AND len(a.lemmas) > 0 AND len(b.lemmas) > 0
        AND NOT (b.row_id % 100 = 0 AND b.row_id < a.row_id))""",
}


# --- what the queries share ---------------------------------------------------------------------------------------


def _people(spark: SparkSession, d: str) -> DataFrame:
    return postings.postings(corpus.paragraphs(spark, d, "persons"), "row_id", "persons", "person")


def _lemmas(spark: SparkSession, d: str) -> DataFrame:
    return postings.postings(corpus.lemmas(spark, d), "row_id", "lemmas", "item")


def _total(spark: SparkSession, d: str) -> int:
    return table(spark, d, "concept_layer").count()


def _most_cited(spark: SparkSession, d: str) -> tuple[list[str], str | None]:
    """The circle, the seven most cited people, and the eighth, the centre: a top-k of fixed size."""
    got = [r[0] for r in _people(spark, d).groupBy("person").count().orderBy(F.desc("count"), "person").limit(8).collect()]
    return got[:7], got[7] if len(got) > 7 else None


def _grouped(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    circle, centre = _most_cited(spark, d)
    name = T.has_term(F.col("text"), [centre.rsplit("_", 1)[-1]]) if centre else F.lit(False)
    flags = {
        "_a": T.has_term(F.col("text"), SEEDS), "_b": F.arrays_overlap("persons", F.array(*map(F.lit, circle)).cast("array<string>")),
        "_c": F.array_contains("persons", centre or ""), "_name": name,
    }
    df = corpus.paragraphs(spark, d, *columns, derived=flags)
    return groups.grouped(df, F.col("_a"), F.col("_b"), F.col("_c"), F.col("_name"))


def _with_vectors(spark: SparkSession, d: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that have a vector, and the vectors keyed by row_id."""
    vec = cut(corpus.vectors(spark, d).select("row_id", "vec"), "vectors")
    return df.join(vec.select("row_id"), "row_id", "left_semi"), vec


def _pair_rows(spark: SparkSession, d: str) -> DataFrame:
    p = corpus.paragraphs(spark, d, "text_id", "persons").join(corpus.lemmas(spark, d), "row_id")
    return p.join(corpus.vectors(spark, d).select("row_id", "vec"), "row_id")


def _asked():
    """The stated query set: rows whose id is divisible by 100, against all rows."""
    return F.col("row_id") % 100 == 0


# --- scans and projections ----------------------------------------------------------------------------------------


@_query("load_paragraphs__S10", "SELECT row_id, issue, text_id, length(text) AS n_chars, len(persons) AS n_persons FROM par", "par")
def _(spark, d):
    return corpus.paragraphs(spark, d, "issue", "text_id", "text", "persons").select("row_id", "issue", "text_id", F.length("text").alias("n_chars"), F.size("persons").alias("n_persons"))


@_query("clean_pointers__P1_P2", "SELECT row_id, person, count(*) AS uses FROM (SELECT row_id, unnest(persons) AS person FROM par) GROUP BY ALL", "par")
def _(spark, d):
    p = corpus.paragraphs(spark, d, "persons")
    return p.select("row_id", F.explode("persons").alias("person")).groupBy("row_id", "person").agg(F.count("*").alias("uses"))


@_query("split_lists__P22", r"SELECT DISTINCT cluster_id, lemma FROM (SELECT cluster_id, trim(unnest(string_split(top_lemmas, ';'))) AS lemma FROM sp3_clusters) WHERE lemma <> ''")
def _(spark, d):
    return table(spark, d, "sp3_clusters").select("cluster_id", F.explode(T.split_ids(F.col("top_lemmas"))).alias("lemma"))


@_query("canonical_terms__P9_A30_X7", "SELECT item, count(*) AS uses, count(DISTINCT row_id) AS n_rows FROM (SELECT row_id, unnest(lemmas) AS item FROM lay) GROUP BY ALL", "lay")
def _(spark, d):
    c = ranking.bag_counts(corpus.lemmas(spark, d), "row_id", "lemmas")
    return c.groupBy("item").agg(F.sum("uses").alias("uses"), F.count("*").alias("n_rows"))


@_query("layer_summary__A30", "SELECT count(*) AS n_rows, count_if(len(lemmas) = 0) AS n_empty, (SELECT count(DISTINCT item) FROM lp) AS n_lemmas FROM lay", "lay", "lp")
def _(spark, d):
    lay = corpus.lemmas(spark, d)
    n = _lemmas(spark, d).select("item").distinct().agg(F.count("*").alias("n_lemmas"))
    return lay.agg(F.count("*").alias("n_rows"), F.count_if(F.size("lemmas") == 0).alias("n_empty")).join(n)


_PERIOD = "CASE " + " ".join(f"WHEN birth_year >= {a} AND birth_year < {b} THEN '{n}'" for a, b, n in people.PERIODS) + " ELSE 'Unknown' END"
_COUNTRY = "CASE lower(trim(country)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in people.COUNTRIES.items()) + " ELSE trim(country) END"
_REGION = "CASE c " + " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in people.REGIONS.items()) + " ELSE 'Other/Unknown' END"
_CTE["pro"] = f"SELECT id, birth_year, c AS country, {_REGION} AS region, period FROM (SELECT id, birth_year, {_COUNTRY} AS c, {_PERIOD} AS period FROM persons_prosopography)"


def _bucketed_people(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "persons_prosopography").select("id", "birth_year", people.country(F.col("country")).alias("country"))
    return p.select("id", "birth_year", "country", people.region(F.col("country")).alias("region"), people.period(F.col("birth_year")).alias("period"))


@_query("demographic_buckets__P7_P8_J8_J9", "SELECT id, birth_year, country, region, period FROM pro", "pro")
def _(spark, d):
    return _bucketed_people(spark, d)


@_query("lexicon_groups__P12_P13_P15_G1_G2", "SELECT row_id, in_a, in_b, in_c, in_d, named, in_a_s, in_b_s FROM grp", "grp")
def _(spark, d):
    return _grouped(spark, d).select("row_id", "in_a", "in_b", "in_c", "in_d", "named", "in_a_s", "in_b_s")


@_query("group_sizes__A29", "SELECT count_if(in_a) AS n_a, count_if(in_b) AS n_b, count_if(in_c) AS n_c, count_if(in_d) AS n_d, count_if(named) AS n_named, count_if(in_a_s) AS n_a_strat, count_if(in_b_s) AS n_b_strat, count_if(in_a AND in_b) AS n_ab, count(*) AS n FROM grp", "grp")
def _(spark, d):
    return groups.sizes(_grouped(spark, d))


_TAGS = {"t_letra": "letras?", "t_rio": "r[ií]os?", "t_ley": "ley|leyes", "t_olvido": "olvido"}
_TAG_SQL = " UNION ALL ".join(f"SELECT row_id, '{k}' AS tag FROM par WHERE regexp_matches(text, '{_TERMS([p])}')" for k, p in _TAGS.items())


@_query("entity_tags__P14_S16", _TAG_SQL, "par")
def _(spark, d):
    return corpus.paragraphs(spark, d, "text").select("row_id", F.explode(T.entity_tags(F.col("text"), _TAGS)).alias("tag"))


_CTE["tok"] = r"SELECT row_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{L}{4,}')))) AS item FROM par"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return corpus.paragraphs(spark, d, "text").select("row_id", F.explode(T.words(F.col("text"))).alias("item"))


@_query("token_frequency__P16_A26", f"SELECT item, count(*) AS n_rows FROM tok WHERE item NOT IN (SELECT word FROM function_words) AND item NOT IN ({', '.join(repr(s) for s in SEEDS)}) GROUP BY ALL", "tok")
def _(spark, d):
    return postings.candidates(_tokens(spark, d), table(spark, d, "function_words").select(F.col("word").alias("item")).distinct(), SEEDS)


@_query("segments__P17")
def _(spark, d):
    s = segment.segmented(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return s.select("doc_id", "place", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@_query("excerpts__P18", r"SELECT row_id, CASE WHEN length(t) > 280 THEN left(t, 280) || '…' ELSE t END AS excerpt FROM (SELECT row_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS t FROM par)", "par")
def _(spark, d):
    return corpus.paragraphs(spark, d, "text").select("row_id", T.excerpt(F.col("text")).alias("excerpt"))


@_query("set_jaccard__P23_P15", "SELECT row_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS jaccard FROM (SELECT row_id, list_distinct(list_filter(coalesce(terms, []), lambda x: x IS NOT NULL)) AS a, list_distinct(list_filter(coalesce(lemmas, []), lambda x: x IS NOT NULL)) AS b FROM concept_layer)")
def _(spark, d):
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return table(spark, d, "concept_layer").select("row_id", F.round(T.jaccard(clean("terms"), clean("lemmas")), 6).alias("jaccard"))


_CTE["inv"] = "SELECT DISTINCT unnest(ana_gold) AS label FROM rec"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return corpus.delivered_once(table(spark, d, "paragraphs"), "row_id", "ana_gold").filter(F.size("ana_gold") > 0)


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    """(item): every label of the data."""
    return _gold(spark, d).select(F.explode("ana_gold").alias("item")).filter("item IS NOT NULL").distinct()


@_query("valid_labels__P25", "SELECT row_id, string_agg(label, ';' ORDER BY pos) AS labels FROM (SELECT row_id, unnest(ana_gold) AS label, generate_subscripts(ana_gold, 1) AS pos FROM rec) SEMI JOIN inv USING (label) GROUP BY row_id", "rec", "inv")
def _(spark, d):
    return evaluation.known_items(_gold(spark, d), "row_id", "ana_gold", _inventory(spark, d)).select("row_id", F.array_join("ana_gold", ";").alias("labels"))


@_query("cache_keys__P11", "SELECT row_id, sha256('m' || chr(0) || 'open' || chr(0) || text || chr(0)) AS key FROM par", "par")
def _(spark, d):
    return inference.with_keys(corpus.paragraphs(spark, d, "text"), "text", "m", "open").select("row_id", "key")


_CTE["leaf"] = f"SELECT g, sha256(string_agg(text, chr(10) ORDER BY row_id)) AS h, count(*) AS n FROM (SELECT row_id, text, (row_number() OVER (ORDER BY row_id) - 1) // {files.FAN} AS g FROM par) GROUP BY g"


@_query("fingerprint__P10_S12_S13", "SELECT sum(n)::BIGINT AS n_rows, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(string_agg(h, chr(10) ORDER BY g)) END AS digest FROM leaf", "par", "leaf")
def _(spark, d):
    return files.fingerprint(corpus.paragraphs(spark, d, "text"), "row_id", "text")


@_query("issue_counts__P26", "SELECT issue, 'prop_' || replace(issue, '-', '_') AS col, count(*) AS n FROM par WHERE issue IS NOT NULL GROUP BY ALL", "par")
def _(spark, d):
    p = corpus.paragraphs(spark, d, "issue").filter("issue IS NOT NULL").groupBy("issue").agg(F.count("*").alias("n"))
    return p.select("issue", F.concat(F.lit("prop_"), F.replace("issue", F.lit("-"), F.lit("_"))).alias("col"), "n")


@_query("titles__J13", "SELECT doc_id, coalesce(nullif(trim(title), ''), source) AS title FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "source").alias("title"))


@_query("note_shares__A10", "SELECT issue, count_if(has_note) AS n_notes, count(*) AS n FROM par GROUP BY ALL", "par")
def _(spark, d):
    return corpus.paragraphs(spark, d, "issue", "has_note").groupBy("issue").agg(F.count_if("has_note").alias("n_notes"), F.count("*").alias("n"))


@_query("unknown_people__J11", "SELECT DISTINCT person FROM pp WHERE person NOT IN (SELECT id FROM persons_prosopography)", "pp")
def _(spark, d):
    return _people(spark, d).select("person").distinct().join(table(spark, d, "persons_prosopography").select(F.col("id").alias("person")), "person", "left_anti")


@_query("aligned_layers__J1", "SELECT count(*) AS n, count(l.row_id) AS with_layer, count(v.row_id) AS with_vector FROM par p LEFT JOIN lay l USING (row_id) LEFT JOIN vec v USING (row_id)", "par", "lay", "vec")
def _(spark, d):
    p = corpus.paragraphs(spark, d)
    lay, vec = corpus.lemmas(spark, d).select("row_id", F.lit(1).alias("l")), corpus.vectors(spark, d).select("row_id", F.lit(1).alias("v"))
    return p.join(lay, "row_id", "left").join(vec, "row_id", "left").agg(F.count("*").alias("n"), F.count("l").alias("with_layer"), F.count("v").alias("with_vector"))


@_query("vector_check__M5", "SELECT count(*) AS n, count_if(abs(nrm - 1) <= 0.001) AS n_unit, count_if(e IS NULL) AS n_null, count_if(bad) AS n_nan, count_if(nrm = 0) AS n_zero, min(len(e)) AS least_width, max(len(e)) AS most_width FROM (SELECT e, bad, CASE WHEN NOT bad THEN sqrt(list_dot_product(e, e)) END AS nrm FROM (SELECT embeddings::DOUBLE[] AS e, list_contains(list_transform(embeddings, lambda v: isnan(v)), true) AS bad FROM para_vectors))")
def _(spark, d):
    return inference.vector_check(table(spark, d, "para_vectors"), "embeddings")


# --- markup and files ---------------------------------------------------------------------------------------------
# The tables are written as TEI documents, one per row, and read back by the scans; the SQL reads the tables.

_XML_SPACE = r"[\s\x0b\x{85}\p{Z}]+"
_LINE = lambda x: f"trim(regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '{_XML_SPACE}', ' ', 'g'))"


def _xml(x):
    """A value as it may stand in a document: no control characters, signs of markup escaped; null is empty."""
    out = F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def _tei(df: DataFrame, name, *body) -> DataFrame:
    """(path, name, content): a document per row; body parts are strings or columns."""
    parts = [F.lit(x) if isinstance(x, str) else x for x in ("<TEI xmlns='http://www.tei-c.org/ns/1.0'><text><body>", *body, "</body></text></TEI>")]
    return df.select(F.lit("").alias("path"), name.cast("string").alias("name"), F.concat(*parts).alias("content"))


def _attribute(name: str, x):
    return F.when(x.isNotNull(), F.concat(F.lit(f' {name}="'), _xml(x), F.lit('"'))).otherwise("")


def _paragraph_documents(spark, d) -> DataFrame:
    p = table(spark, d, "paragraphs").withColumn("persons", T.clean_ids(F.col("persons")))
    p = corpus.delivered_once(p, "row_id", "para_id", "text_id", "div_type", "text", "persons", "has_note")
    refs = F.array_join(F.transform("persons", lambda x: F.concat(F.lit("#"), x)), " ")
    note = F.when(F.col("has_note"), ' <note resp="#ED">nota<persName ref="#en_nota"/></note>').otherwise("")
    outside = F.when(F.col("row_id") % 2 == 1, "<note>fuera</note>").otherwise("")
    return _tei(
        p, F.col("row_id"), "<div", _attribute("xml:id", F.coalesce("text_id", F.lit("sin"))), _attribute("type", F.coalesce("div_type", F.lit("texto"))), ">", outside, "<p", _attribute("xml:id", F.col("para_id")), ">",
        _xml(F.col("text")), "<persName", _attribute("ref", refs), "/>", note, "</p></div>",
    )


@_query("markup_paragraphs__S1_S2_P2_P3_P4", f"SELECT row_id, para_id, coalesce(text_id, 'sin') AS text_id, coalesce(div_type, 'texto') AS div_type, array_to_string(persons, ' ') AS persons, coalesce(has_note, false) AS has_note, md5({_LINE('coalesce(text, chr(32)) || CASE WHEN has_note THEN chr(32) || chr(110) || chr(111) || chr(116) || chr(97) ELSE chr(32) END')}) AS digest FROM rec", "rec")
def _(spark, d):
    """Every record's paragraph as the scan reads it from its document: mentions within notes aren't cited."""
    got = markup.extracted(_paragraph_documents(spark, d), markup.paragraph_rows)
    return got.select(F.col("issue").cast("long").alias("row_id"), "para_id", "text_id", "div_type", F.array_join("persons", " ").alias("persons"), "has_note", F.md5("text").alias("digest"))


@_query("markup_notes__S7", "SELECT count_if(has_note) + count_if(row_id % 2 = 1) AS n_notes, count_if(has_note) AS n_ed, count_if(has_note) AS n_ed_in_p, count_if(has_note) AS n_notes_in_p FROM rec", "rec")
def _(spark, d):
    return markup.note_counts(markup.extracted(_paragraph_documents(spark, d), markup.note_rows))


@_query("markup_titles__S8", f"SELECT doc_id, coalesce(nullif({_LINE('title')}, ''), {_LINE('source')}, '') AS title FROM documents")
def _(spark, d):
    """The first non-empty head of two divisions of one key."""
    div = lambda x: F.concat(F.lit("<div xml:id='t'><head>"), _xml(F.col(x)), F.lit("</head></div>"))
    docs = _tei(table(spark, d, "documents", "doc_id", "title", "source"), F.col("doc_id"), "<div><p/></div>", div("title"), div("source"))
    keyed = docs.withColumn("content", F.replace("content", F.lit("xml:id='t'"), F.concat(F.lit("xml:id='"), F.col("name"), F.lit("'"))))
    got = markup.extracted(keyed, markup.title_rows).filter(F.col("text_id").try_cast("long").isNotNull())
    return got.select(F.col("text_id").cast("long").alias("doc_id"), "title")


@_query("markup_concepts__S3", "SELECT DISTINCT unnest(ana_gold) AS id, upper(unnest(ana_gold)) AS label FROM rec", "rec")
def _(spark, d):
    """The inventory of concepts; one without an id is skipped."""
    one = F.transform("ana_gold", lambda x: F.concat(F.lit("<interp xml:id='"), _xml(x), F.lit("'> "), _xml(F.upper(x)), F.lit("\n</interp>")))
    docs = _tei(_gold(spark, d), F.col("row_id"), "<interpGrp><interp>sin id</interp>", F.array_join(one, ""), "</interpGrp>")
    return markup.extracted(docs, markup.concept_rows).distinct()


_CTE["mpro"] = f"SELECT id, {_LINE('coalesce(name, chr(32))')} AS name, birth_year, death_year, c AS country, {_REGION} AS region, {_PERIOD} AS period, wikidata FROM (SELECT * EXCLUDE (country), {_COUNTRY.replace('trim(country)', 'tc')} AS c FROM (SELECT *, nullif({_LINE('country')}, '') AS tc FROM persons_prosopography))"


@_query("markup_people__S4_S5_S6_P6", "SELECT id, name, birth_year, death_year, country, region, period FROM mpro", "mpro")
def _(spark, d):
    """Persons and places of documents, joined: years from dates, the place's country, its region, the year's period."""
    p = table(spark, d, "persons_prosopography", "id", "name", "birth_year", "death_year", "country")
    year = lambda c: F.concat(F.when(F.col(c) < 0, "-").otherwise(""), F.lpad(F.abs(c).cast("string"), 4, "0"))
    when = lambda tag, c, more="": F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{tag}><date when='"), year(c), F.lit(f"{more}'/>"))).otherwise(f"<{tag}>")
    has = F.col("country").isNotNull() & (F.trim(F.regexp_replace("country", r"[\s\p{Z}]+", "")) != "")
    place = F.when(has, F.concat(F.lit("<place"), _attribute("xml:id", F.concat(F.lit("pl_"), F.col("id"))), F.lit("><location><country>"), _xml(F.col("country")), F.lit("</country></location></place>"))).otherwise("")
    docs = _tei(
        p, F.col("id"), "<listPlace>", place, "</listPlace><listPerson><person", _attribute("xml:id", F.col("id")), "><persName>", _xml(F.col("name")), "</persName>",
        when("birth", "birth_year", "-10-30"), "<placeName", _attribute("ref", F.concat(F.lit("#pl_"), F.col("id"))), "/></birth>", when("death", "death_year"), "</death></person></listPerson>",
    )
    got = people.prosopography(markup.extracted(docs, markup.person_rows), markup.extracted(docs, markup.place_rows))
    return got.select("id", "name", "birth_year", "death_year", "country", "region", "period")


@_query("saved_table__K1_K2_S11", "SELECT id, name, country FROM persons_prosopography")
def _(spark, d):
    """A table written as Parquet, read, written as CSV and read again."""
    one, two = new_path(spark, "saved"), new_path(spark, "csv")
    files.write_parquet(table(spark, d, "persons_prosopography", "id", "name", "country"), one)
    files.write_csv(spark.read.parquet(one), two)
    return files.csv(spark, two, "id string, name string, country string")


@_query("saved_settings__K3_S14", f"SELECT count(*) AS n_rows, '{'; '.join(SEEDS)}' AS seeds FROM concept_layer")
def _(spark, d):
    """Provenance written as JSON and read as settings."""
    path = new_path(spark, "settings")
    files.write_manifest(table(spark, d, "concept_layer").agg(F.count("*").alias("n_rows")).withColumn("seeds", F.array(*map(F.lit, SEEDS))), path)
    return files.settings(spark, path, "n_rows long, seeds array<string>").select("n_rows", F.array_join("seeds", "; ").alias("seeds"))


@_query("stop_words__S15", r"SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(trim(word)), '\s+')) AS word FROM function_words) WHERE regexp_full_match(word, '\p{L}+')")
def _(spark, d):
    path = new_path(spark, "words")
    words = table(spark, d, "function_words", "word").select(F.col("word").alias("value")).filter("value IS NOT NULL")
    words.union(spark.createDataFrame([("# nota",), ("",)], "value string")).write.text(path)
    return files.stop_words(spark, path)


@_query("open_words__P21", r"SELECT DISTINCT row_id, word FROM (SELECT row_id, unnest(list_filter(regexp_extract_all(lower(array_to_string(list_filter(terms, lambda x: x IS NOT NULL), ' ')), '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{L}{3,}'))) AS word FROM concept_layer) WHERE word NOT IN (SELECT word FROM function_words WHERE word IS NOT NULL)")
def _(spark, d):
    """The open words of each record's terms, with accents, without stop words."""
    got = table(spark, d, "concept_layer").select("row_id", F.explode(T.open_words(F.array_join("terms", ";"))).alias("word"))
    return got.join(table(spark, d, "function_words", "word").distinct(), "word", "left_anti").select("row_id", "word")


# --- postings and associations ------------------------------------------------------------------------------------


@_query("postings__A1_X8", "SELECT row_id, item FROM lp SEMI JOIN lf USING (item)", "lp", "lf")
def _(spark, d):
    return postings.frequent(_lemmas(spark, d), 10)[0]


def _map_sql(group: str, post: str) -> str:
    return rf"""SELECT item, {group}, a, n_group, n_item, log_odds, round(p, 6) AS p, round(q, 6) AS q, q < 0.05 AS significant FROM (
      SELECT *, least(1, min(p * m / rk) OVER (ORDER BY rk DESC)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM (
        SELECT item, {group}, a, n_group, n_item, round(ln((a + 0.5) * (dd + 0.5) / ((b + 0.5) * (c + 0.5))), 3) AS log_odds, least(1, list_sum(list_transform(list_filter(lps, lambda x: x <= lp0 + 1e-7), lambda x: exp(x)))) AS p FROM (
          SELECT *, list_transform(range(greatest(0, n_group + n_item - n), least(n_group, n_item) + 1), lambda k: w - lgamma(k + 1) - lgamma(n_group - k + 1) - lgamma(n_item - k + 1) - lgamma(n - n_group - n_item + k + 1)) AS lps,
            w - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(dd + 1) AS lp0 FROM (
            SELECT *, n_group - a AS b, n_item - a AS c, n - n_group - n_item + a AS dd, lgamma(n_group + 1) + lgamma(n - n_group + 1) + lgamma(n_item + 1) + lgamma(n - n_item + 1) - lgamma(n + 1) AS w FROM (
              SELECT x.item, y.{group}, count(*) AS a, max(n_group) AS n_group, max(n_item) AS n_item FROM lp x JOIN lf USING (item) JOIN {post} y USING (row_id) GROUP BY ALL HAVING count(*) >= 3), tot)))))"""


def _map(spark, d, post: DataFrame, group: str, least: int) -> DataFrame:
    return assoc.tested(assoc.cells(_lemmas(spark, d), post, "row_id", _total(spark, d), "item", group, 10, least))


_CTE["ppf"] = "SELECT row_id, person, n_group FROM pp JOIN pf USING (person)"
_CTE["isf"] = "SELECT row_id, issue, count(*) OVER (PARTITION BY issue) AS n_group FROM par WHERE issue IS NOT NULL"
for _dim in ("period", "region"):
    _CTE[f"b{_dim}"] = f"SELECT *, count(*) OVER (PARTITION BY {_dim}) AS n_group FROM (SELECT DISTINCT row_id, {_dim} FROM pp JOIN pro ON id = person)"


@_query("concept_person_map__A2_A3_A4_A5_A6_O1_P24", _map_sql("person", "ppf"), "lp", "lf", "ppf", "tot")
def _(spark, d):
    return _map(spark, d, _people(spark, d), "person", 5)


@_query("concept_issue_map__A7", _map_sql("issue", "isf"), "lp", "lf", "isf", "tot")
def _(spark, d):
    return _map(spark, d, corpus.paragraphs(spark, d, "issue").filter("issue IS NOT NULL"), "issue", 0)


@_query("concept_period_map__A8", _map_sql("period", "bperiod"), "lp", "lf", "bperiod", "tot")
def _(spark, d):
    return _map(spark, d, people.bucketed(_people(spark, d), _bucketed_people(spark, d), "row_id", "person", "period").withColumnRenamed("bucket", "period"), "period", 0)


@_query("concept_region_map__A8", _map_sql("region", "bregion"), "lp", "lf", "bregion", "tot")
def _(spark, d):
    return _map(spark, d, people.bucketed(_people(spark, d), _bucketed_people(spark, d), "row_id", "person", "region").withColumnRenamed("bucket", "region"), "region", 0)


@_query("anchor__R19", f"""SELECT count(*) AS n_cells, coalesce(count_if(log_odds > 0), 0) AS n_pos, coalesce(count_if(significant), 0) AS n_sig, round(coalesce(count_if(log_odds > 0) / nullif(count(*), 0), 0), 3) AS frac_pos,
    count(*) >= 3 AND coalesce(count_if(log_odds > 0) / nullif(count(*), 0), 0) >= 0.6 AND coalesce(count_if(significant), 0) >= 1 AS ok FROM ({_map_sql("person", "ppf")}) SEMI JOIN circle USING (person) WHERE item IN ({", ".join(repr(s) for s in SEEDS)})""", "lp", "lf", "ppf", "tot", "circle")  # fmt: skip
def _(spark, d):
    return assoc.anchor(_map(spark, d, _people(spark, d), "person", 5), F.col("person").isin(_most_cited(spark, d)[0]) & F.col("item").isin(SEEDS))


_OF = lambda x: "CASE issue " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(ISSUES, 1)) + f" END AS {x}"
_SHARES = ", ".join(f"round(a_{i} / n_{i}, 4) AS share_{i}" for i in range(1, 6))
_TREND = f"""SELECT item, n_item, {_SHARES}, CASE WHEN z > 0 THEN 'rising' WHEN z < 0 THEN 'falling' ELSE 'flat' END AS direction, round(z, 3) AS z FROM (
    SELECT *, CASE WHEN held > 0 AND held < nn AND held / nn * (1 - held / nn) * sp > 0 THEN u / sqrt(held / nn * (1 - held / nn) * sp) ELSE 0 END AS z FROM (
    SELECT item, n_item, {", ".join(f"count_if(t = {i}) AS a_{i}, max(n_{i}) AS n_{i}" for i in range(1, 6))}, count(t) AS held, max(nn) AS nn, max(sp) AS sp, sum(coalesce(t - mean, 0)) AS u
    FROM lp JOIN lf USING (item) LEFT JOIN (SELECT row_id, {_OF("t")} FROM par) USING (row_id), (
      SELECT *, {" + ".join(f"n_{i} * ({i} - mean) ** 2" for i in range(1, 6))} AS sp FROM (SELECT {", ".join(f"count_if(t = {i}) AS n_{i}" for i in range(1, 6))}, count(t) AS nn, avg(t) AS mean FROM (SELECT {_OF("t")} FROM par)))
    GROUP BY ALL))"""


def _trends(spark, d):
    return assoc.trends(_lemmas(spark, d), corpus.paragraphs(spark, d, "issue"), "row_id", ISSUES, "item", "issue")


@_query("trend_statistics__A19_A20", _TREND, "lp", "lf", "par")
def _(spark, d):
    return _trends(spark, d).drop("p", "q")


# the two-sided normal tail by the series of erf, whose terms are all positive
_TAIL = "(SELECT CASE WHEN x = 0 THEN 1.0 WHEN x > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(x) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))) END FROM (SELECT abs({0}) / sqrt(2) AS x))"
_CTE["trz"] = _TREND.replace("round(z, 3) AS z", "z")
_CTE["trp"] = f"SELECT *, CASE WHEN z = 0 THEN 1.0 ELSE greatest(0, {_TAIL.format('trz.z')}) END AS p FROM trz"


@_query("trend_table__A19_A20_O10_O1", f"SELECT * EXCLUDE (z, p, q, m, rk), round(z, 3) AS z, round(p, 6) AS p, round(q, 6) AS q FROM (SELECT *, least(1, min(p * m / rk) OVER (ORDER BY rk DESC)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM trp))", "lp", "lf", "par", "trp")
def _(spark, d):
    return _trends(spark, d)


_CTE["prof"] = """SELECT * FROM (SELECT row_id, person, unnest([{'dim': 'period', 'bucket': period}, {'dim': 'region', 'bucket': region}, {'dim': 'origin', 'bucket': CASE WHEN country IS NULL THEN 'Unknown origin' WHEN country = 'Argentina' THEN 'Argentina' ELSE 'Foreign' END}], recursive := true) FROM pp JOIN pro ON id = person)"""


@_query("profile__A23_O12", "SELECT dim, bucket, count(DISTINCT person) AS n_figures, count(DISTINCT row_id) AS n_rows FROM prof GROUP BY ALL", "prof")
def _(spark, d):
    return people.profile(_people(spark, d), _bucketed_people(spark, d), "row_id", "person", "Argentina")


_CTE["itn"] = "SELECT item, issue, count(*) AS k FROM lp JOIN lf USING (item) JOIN par USING (row_id) WHERE issue IS NOT NULL GROUP BY ALL"


@_query("dispersion__A24", "SELECT item, round(max(k) / sum(k), 6) AS dispersion, (arg_max(issue, (k, issue))) AS dominant FROM itn GROUP BY item", "itn")
def _(spark, d):
    got = postings.frequent(_lemmas(spark, d), 10)[0].join(corpus.paragraphs(spark, d, "issue").filter("issue IS NOT NULL"), "row_id").groupBy("item", "issue").agg(F.count("*").alias("k"))
    return got.groupBy("item").agg(F.round(F.max("k") / F.sum("k"), 6).alias("dispersion"), F.max_by("issue", F.struct("k", "issue")).alias("dominant"))


@_query("tfidf_ranks__A12_O4", "SELECT item, n_rows, score, rank FROM tfr", "tfr")
def _(spark, d):
    c = cut(ranking.bag_counts(corpus.lemmas(spark, d), "row_id", "lemmas"), "bags")
    return ranking.ranked(ranking.tfidf_scores(c, "row_id", _total(spark, d)))


def _raw_uses(spark, d) -> DataFrame:
    from scriptoria.functions.folding import canonical

    raw = table(spark, d, "concept_layer").select("row_id", F.explode("lemmas").alias("form")).filter("form IS NOT NULL")
    return raw.select("row_id", canonical("form").alias("lemma"), "form").filter("lemma <> ''")


_CTE["raw"] = rf"SELECT row_id, form, trim(regexp_replace(strip_accents(lower(form)), '{_B}+', ' ', 'g')) AS lemma FROM (SELECT row_id, unnest(lemmas) AS form FROM concept_layer) WHERE form IS NOT NULL AND trim(regexp_replace(form, '{_B}+', ' ', 'g')) <> ''"
_CTE["ing"] = "SELECT c.row_id, c.para_id AS label, coalesce(g.in_b OR g.in_c, false) AS in_group FROM concept_layer c LEFT JOIN grp g USING (row_id)"


@_query("candidate_table__A11_O11_T5_J14", f"""SELECT m.lemma, n_instances, m.n_rows, tfr.rank AS tfidf_rank, example_forms, coalesce(example_ids, '') AS example_ids, round(ln(((c_in + 0.5) / (m.n_rows - c_in + 0.5)) / ((SELECT (count_if(in_group) + 0.5) / (count_if(NOT in_group) + 0.5) FROM ing))), 3) AS enrichment_score,
    m.lemma IN ({", ".join(repr(s) for s in SEEDS)}) AS in_seeds, '' AS keep FROM (SELECT lemma, sum(k)::BIGINT AS n_instances, count(*) AS n_rows, count_if(in_group) AS c_in FROM (SELECT lemma, row_id, count(*) AS k FROM raw GROUP BY ALL) JOIN ing USING (row_id) GROUP BY lemma) m
    JOIN (SELECT lemma, string_agg(form, '; ' ORDER BY r) AS example_forms FROM (SELECT lemma, form, row_number() OVER (PARTITION BY lemma ORDER BY count(*) DESC, form) AS r FROM raw GROUP BY lemma, form) WHERE r <= 3 GROUP BY lemma) f USING (lemma)
    LEFT JOIN (SELECT lemma, string_agg(label, '; ' ORDER BY r) AS example_ids FROM (SELECT lemma, label, row_number() OVER (PARTITION BY lemma ORDER BY row_id) AS r FROM (SELECT DISTINCT lemma, row_id FROM raw) JOIN ing USING (row_id)) WHERE r <= 3 AND label <> '' GROUP BY lemma) e USING (lemma)
    LEFT JOIN tfr ON tfr.item = m.lemma""", "raw", "ing", "tfr")  # fmt: skip
def _(spark, d):
    g = _grouped(spark, d).select("row_id", (F.col("in_b") | F.col("in_c")).alias("g"))
    rows = table(spark, d, "concept_layer").select("row_id", F.col("para_id").alias("label")).join(g, "row_id", "left").select("row_id", "label", F.coalesce("g", F.lit(False)).alias("in_group"))
    c = cut(ranking.bag_counts(corpus.lemmas(spark, d), "row_id", "lemmas"), "bags")
    ranks = ranking.ranked(ranking.tfidf_scores(c, "row_id", _total(spark, d)))
    return ranking.candidate_table(cut(_raw_uses(spark, d), "forms"), cut(rows, "rows"), "row_id", SEEDS, ranks)


@_query("surface_forms__A27", "SELECT lemma, array_to_string(list_sort(list_distinct(list_append(list(DISTINCT trim(form)), lemma))), ';') AS forms FROM raw GROUP BY lemma", "raw")
def _(spark, d):
    f = postings.surface_forms(_raw_uses(spark, d).withColumn("form", F.trim("form")), "lemma", "form")
    return f.select("lemma", F.array_join("forms", ";").alias("forms"))


_CTE["top_t"] = "SELECT item FROM tfr WHERE rank <= 100"
_CTE["top_c"] = "SELECT item FROM bag GROUP BY item ORDER BY count(*) DESC, item LIMIT 100"


@_query("list_overlap__R21_G7_O9", "SELECT (SELECT count(*) FROM top_t SEMI JOIN top_c USING (item)) AS n_both, (SELECT count(*) FROM (SELECT item FROM top_t UNION SELECT item FROM top_c)) AS n_any, round((SELECT count(*) FROM top_t SEMI JOIN top_c USING (item)) / (SELECT count(*) FROM (SELECT item FROM top_t UNION SELECT item FROM top_c)), 6) AS jaccard, (SELECT coalesce(string_agg(item, '; ' ORDER BY item), '') FROM (SELECT item FROM top_c ANTI JOIN top_t USING (item) ORDER BY item LIMIT 10)) AS left_only", "top_t", "top_c")
def _(spark, d):
    c = cut(ranking.bag_counts(corpus.lemmas(spark, d), "row_id", "lemmas"), "bags")
    by_count = ranking.top(postings.frequency(c), 100, F.col("n_rows").desc(), F.col("item"))
    by_score = ranking.top(ranking.tfidf_scores(c, "row_id", _total(spark, d)).withColumn("score", F.round("score", 6)), 100, F.col("score").desc(), F.col("item"))
    return ranking.list_overlap(cut(by_count.select("item"), "left"), cut(by_score.select("item"), "right"))


# --- evaluation ---------------------------------------------------------------------------------------------------

_CTE["ev"] = "SELECT r.row_id, list_distinct(r.ana_gold) AS g, list_intersect(list_distinct(list_transform(l.lemmas, lambda x: 'ana_' || x)), (SELECT list(label) FROM labs)) AS p, len(l.lemmas) AS n_open FROM rec r JOIN lay l USING (row_id) WHERE len(r.ana_gold) > 0"
_CTE["labs"] = "SELECT DISTINCT unnest(ana_gold) AS label FROM rec"


def _evaluated(spark, d):
    """Labelled rows with their lemmas and, as predicted labels, those lemmas that the inventory knows."""
    p = cut(_gold(spark, d).join(corpus.lemmas(spark, d), "row_id"), "evaluated")
    tagged = p.select("row_id", F.array_distinct(F.transform("lemmas", lambda x: F.concat(F.lit("ana_"), x))).alias("predicted"))
    return p.join(evaluation.known_items(tagged, "row_id", "predicted", _inventory(spark, d)), "row_id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))


@_query("micro_scores__A21_P25", "SELECT tp, fp, fn, round(pr, 3) AS precision, round(re, 3) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 3) AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM (SELECT sum(len(list_intersect(g, p)))::BIGINT AS tp, sum(len(p) - len(list_intersect(g, p)))::BIGINT AS fp, sum(len(g) - len(list_intersect(g, p)))::BIGINT AS fn FROM ev))", "ev")
def _(spark, d):
    return evaluation.micro(evaluation.matches(_evaluated(spark, d), F.col("ana_gold"), F.col("predicted")))


@_query("row_scores__A21_J2", "SELECT row_id, len(list_intersect(g, p)) AS tp, len(p) - len(list_intersect(g, p)) AS fp, len(g) - len(list_intersect(g, p)) AS fn FROM ev", "ev")
def _(spark, d):
    return evaluation.matches(evaluation.require_unique(_evaluated(spark, d), "row_id"), F.col("ana_gold"), F.col("predicted")).select("row_id", "tp", "fp", "fn")


@_query("metric_summary__A22", "SELECT round(avg(len(p)), 6) AS mean_predicted, round(avg(len(g)), 6) AS mean_gold, round(avg(n_open), 6) AS mean_open FROM ev", "ev")
def _(spark, d):
    e = _evaluated(spark, d)
    return e.agg(F.round(F.avg(F.size("predicted")), 6).alias("mean_predicted"), F.round(F.avg(F.size(F.array_distinct("ana_gold"))), 6).alias("mean_gold"), F.round(F.avg(F.size("lemmas")), 6).alias("mean_open"))


@_query("group_rates__A10", "SELECT contributor, count(*) AS n, round(avg(in_a::INT), 6) AS rate, round(avg(in_a::INT) / (SELECT avg(in_a::INT) FROM grp), 6) AS ratio FROM grp JOIN par USING (row_id) GROUP BY contributor", "grp", "par")
def _(spark, d):
    g = cut(_grouped(spark, d, "contributor").select("contributor", F.col("in_a").cast("int").alias("a")), "rates")
    base = g.agg(F.avg("a").alias("base"))
    return g.groupBy("contributor").agg(F.count("*").alias("n"), F.avg("a").alias("rate")).join(base).select("contributor", "n", F.round("rate", 6).alias("rate"), F.round(F.try_divide(F.col("rate"), F.col("base")), 6).alias("ratio"))


# --- vectors and the probe ----------------------------------------------------------------------------------------


_MEANS = """SELECT contributor, n_a, n_b, round(sum(s * t) / (n_a * n_b), 6) AS mean_cos FROM
    (SELECT contributor, dim, sum(x) AS s, count(*) AS n_a FROM (SELECT contributor, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM gv JOIN par USING (row_id)) GROUP BY ALL)
    JOIN (SELECT dim, sum(x) AS t, count(*) AS n_b FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM gv WHERE in_b) GROUP BY ALL) USING (dim) GROUP BY contributor, n_a, n_b"""


@_query("mean_cosines__A9_J7_M7", _MEANS, "gv", "par")
def _(spark, d):
    g, vec = _with_vectors(spark, d, _grouped(spark, d, "contributor"))
    g = cut(g.select("row_id", "contributor", "in_b").join(vec, "row_id"), "grouped")
    a = g.withColumn("contributor", F.coalesce("contributor", F.lit("\x00")))
    got = vectors.mean_cross_cosine(a, g.filter("in_b"), by=["contributor"])
    return got.select(F.nullif("contributor", F.lit("\x00")).alias("contributor"), "n_a", "n_b", F.round("mean_cos", 6).alias("mean_cos"))


@_query("closest_contributor__A32", f"SELECT contributor, mean_cos FROM ({_MEANS}) ORDER BY mean_cos DESC, contributor DESC NULLS LAST LIMIT 1", "gv", "par")
def _(spark, d):
    m = _Q["mean_cosines__A9_J7_M7"](spark, d)
    return m.agg(F.max_by("contributor", F.struct("mean_cos", "contributor")).alias("contributor"), F.max("mean_cos").alias("mean_cos"))


_CLASSES = {"A-A": ("in_a", "in_a"), "A-B": ("in_a", "in_b"), "A-C": ("in_a", "in_c"), "A-D": ("in_a", "in_d"), "As-Bs": ("in_a_s", "in_b_s"), "As-D": ("in_a_s", "in_d")}


def _members_sql(classes: dict[str, tuple[str, str]], source: str = "gv") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS run, {s} AS side, row_id FROM {source} WHERE {col}" for c, p in classes.items() for s, col in enumerate(p))


def _cross_sql(members: str, seed: str, n: int = N) -> str:
    """Pairs (run, i, j) of (run, side, row_id), as `sampling.cross_pairs` draws them."""
    return f"""SELECT p.run, l.row_id AS i, r.row_id AS j FROM (
      SELECT run, CASE WHEN l * r <= {n} THEN k // r ELSE k % l END AS x, CASE WHEN l * r <= {n} THEN k % r ELSE ('0x' || substr(md5('{seed}|' || run || '|' || k), 1, 8))::BIGINT % r END AS y FROM (
        SELECT run, l, r, unnest(range(least(l * r, {n})::BIGINT)) AS k FROM (SELECT run, count_if(side = 0 AND place <= {n}) AS l, count_if(side = 1 AND place <= {n}) AS r FROM ({members}) GROUP BY run) WHERE l > 0 AND r > 0)) p
      JOIN ({members}) l ON l.run = p.run AND l.side = 0 AND l.place = x + 1 JOIN ({members}) r ON r.run = p.run AND r.side = 1 AND r.place = y + 1 WHERE l.row_id <> r.row_id"""


def _placed_sql(members: str, seed: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY run, side ORDER BY md5('{seed}|' || run || '|' || side || '|' || row_id), row_id) AS place FROM ({members})"


_DELTA = "2 * sum(x * (below + 0.5 * y)) / nullif(sum(x)::DOUBLE * sum(y), 0) - 1"


def _delta_sql(samples: str, by: str = "run") -> str:
    """(by, n_x, n_y, delta) of (by, cos, is_x)."""
    return f"""SELECT {by}, sum(x)::BIGINT AS n_x, sum(y)::BIGINT AS n_y, round({_DELTA}, 6) AS delta FROM (
      SELECT *, sum(y) OVER (PARTITION BY {by} ORDER BY cos) - y AS below FROM (SELECT {by}, cos, count_if(is_x) AS x, count_if(NOT is_x) AS y FROM ({samples}) GROUP BY ALL)) GROUP BY {by}"""


_CTE["pm"] = _placed_sql(_members_sql(_CLASSES), "probe")
_CTE["pcos"] = f"SELECT run, round({_DOT}(a.vec, b.vec), 9) AS cos FROM ({_cross_sql('SELECT * FROM pm', 'probe')}) p JOIN vec a ON a.row_id = i JOIN vec b ON b.row_id = j"
_CTE["pdel"] = _delta_sql("SELECT c.run AS class, p.cos, p.run = c.run AS is_x FROM (SELECT DISTINCT run FROM pcos) c JOIN pcos p ON p.run = c.run OR p.run = 'A-D' WHERE c.run <> 'A-D'", "class")


def _probe_cosines(spark, d) -> DataFrame:
    g, vec = _with_vectors(spark, d, _grouped(spark, d))
    members = groups.sides(g, "row_id", _CLASSES)
    return cut(probe.pair_cosines(sampling.cross_pairs(members, "row_id", N, "probe"), vec, "row_id"), "cosines")


@_query("probe_classes__R11_R2_A13", "SELECT run AS class, count(*) AS n_pairs, round(quantile_cont(cos, 0.5), 6) AS median, round(quantile_cont(cos, 0.25), 6) AS iqr_low, round(quantile_cont(cos, 0.75), 6) AS iqr_high, CASE WHEN run = 'A-D' THEN 0 ELSE any_value(delta) END AS delta FROM pcos LEFT JOIN pdel ON class = run GROUP BY run", "pcos", "pdel")
def _(spark, d):
    return probe.class_table(_probe_cosines(spark, d), "A-D").drop("p")


@_query("probe_table__R11_A17")
def _(spark, d):
    return probe.class_table(_probe_cosines(spark, d), "A-D")


@_query("probe_delta__R12", _delta_sql("SELECT 'probe' AS run, cos, run = 'A-B' AS is_x FROM pcos WHERE run IN ('A-B', 'A-D')"), "pcos")
def _(spark, d):
    g, vec = _with_vectors(spark, d, _grouped(spark, d))
    members = groups.sides(g, "row_id", {k: _CLASSES[k] for k in ("A-B", "A-D")})
    cos = probe.pair_cosines(sampling.cross_pairs(members, "row_id", N, "probe"), vec, "row_id").withColumn("is_x", F.col("run") == "A-B").withColumn("run", F.lit("probe"))
    return rankstats.two_samples(cos, "cos", F.col("is_x"), ["run"]).select("run", "n_x", "n_y", F.round("delta", 6).alias("delta"))


_PAIR_COS = lambda members, seed, n=N: f"SELECT run, round({_DOT}(a.vec, b.vec), 9) AS cos FROM ({_cross_sql(members, seed, n)}) p JOIN vec a ON a.row_id = i JOIN vec b ON b.row_id = j"
_CTE["nm"] = _placed_sql(_members_sql(_CLASSES, "(SELECT g.* FROM gv g JOIN par p USING (row_id) WHERE NOT p.has_note)"), "probe")
_CTE["ncos"] = _PAIR_COS("SELECT * FROM nm", "probe")
_ONCE |= {"pm", "pcos", "nm", "ncos"}


@_query("no_note_probe__R15", _delta_sql("SELECT 'A-B' AS class, cos, run = 'A-B' AS is_x FROM ncos WHERE run IN ('A-B', 'A-D') UNION ALL SELECT 'As-Bs', cos, run = 'As-Bs' FROM ncos WHERE run IN ('As-Bs', 'As-D')", "class"), "gv", "par", "ncos")
def _(spark, d):
    g, vec = _with_vectors(spark, d, _grouped(spark, d, "has_note").filter(~F.col("has_note")))
    cos = cut(probe.pair_cosines(sampling.cross_pairs(groups.sides(g, "row_id", _CLASSES), "row_id", N, "probe"), vec, "row_id"), "cosines")
    return probe.against(cos, {"A-B": "A-D", "As-Bs": "As-D"}).select("class", "n_x", "n_y", F.round("delta", 6).alias("delta"))


def _deltas_sql(name: str, kinds: str, seed: str, stratified: bool = False) -> str:
    """`probe.deltas` of the CTE `kinds` (run, kind, row_id); its members and cosines become CTEs of their own."""
    classes = probe.CLASSES | (probe.STRATIFIED if stratified else {})
    each = [f"SELECT run || '/{c}' AS run, CASE WHEN kind = '{x}' THEN 0 ELSE 1 END AS side, row_id FROM {kinds} WHERE kind IN ('{x}', '{y}')" for c, (x, y) in classes.items()]
    _CTE[f"{name}_m"] = _placed_sql(" UNION ALL ".join(each), seed)
    _CTE[f"{name}_c"] = f"SELECT regexp_extract(run, '^(.*)/..$', 1) AS run, right(run, 2) AS c, cos FROM ({_PAIR_COS(f'SELECT * FROM {name}_m', seed)})"
    _ONCE.update((kinds, f"{name}_m", f"{name}_c"))
    of = lambda x, y: _delta_sql(f"SELECT run, cos, c = '{x}' AS is_x FROM {name}_c WHERE c IN ('{x}', '{y}')")
    if not stratified:
        return f"SELECT run, n_x AS n_ab, n_y AS n_ad, delta FROM ({of('ab', 'ad')})"
    return f"SELECT coalesce(p.run, s.run) AS run, coalesce(p.n_x, 0) AS n_ab, coalesce(p.n_y, 0) AS n_ad, p.delta, coalesce(s.n_x, 0) AS n_sb, coalesce(s.n_y, 0) AS n_sd, s.delta AS delta_s FROM ({of('ab', 'ad')}) p FULL JOIN ({of('sb', 'sd')}) s ON p.run = s.run"


_CTE["loov"] = "SELECT v, m FROM (SELECT 'full' AS v, person AS m FROM circle UNION ALL SELECT 'minus_' || a.person, b.person FROM circle a JOIN circle b ON a.person <> b.person UNION ALL SELECT 'only_' || person, person FROM circle)"
_CTE["lookinds"] = """SELECT v AS run, unnest(CASE WHEN g.named THEN ['b'] ELSE ['b', 'bs'] END) AS kind, row_id FROM (SELECT DISTINCT v, row_id FROM loov JOIN pp ON person = m) JOIN gv g USING (row_id)
    UNION ALL SELECT v, unnest(list_filter([CASE WHEN in_a THEN 'a' END, CASE WHEN in_a_s THEN 'as' END, CASE WHEN in_d THEN 'd' END], lambda x: x IS NOT NULL)), row_id FROM (SELECT DISTINCT v FROM loov), gv"""
_LOO = _deltas_sql("loo", "lookinds", "loo", True)


@_query("leave_one_out__R16_G3_G5", f"SELECT run AS variant, * EXCLUDE (run) FROM ({_LOO})", "loo_c")
def _(spark, d):
    circle, _centre = _most_cited(spark, d)
    g, vec = _with_vectors(spark, d, _grouped(spark, d))
    g = cut(g.select("row_id", "in_a", "in_a_s", "in_d", "named"), "grouped")
    b = groups.leave_one_out(_people(spark, d).withColumnRenamed("person", "item"), circle, "row_id").join(g.select("row_id", "named"), "row_id")
    runs = F.explode(F.array(*map(F.lit, ["full", *(f"minus_{c}" for c in circle), *(f"only_{c}" for c in circle)]))).alias("run")
    of = lambda **kinds: F.explode(F.array_compact(F.array(*[F.when(c, k.rstrip("_")) for k, c in kinds.items()]))).alias("kind")
    fixed = g.select(of(a=F.col("in_a"), as_=F.col("in_a_s"), d=F.col("in_d")), "row_id").select(runs, "kind", "row_id")
    members = b.select(F.col("variant").alias("run"), of(b=F.lit(True), bs=~F.col("named")), "row_id").unionByName(fixed)
    return probe.deltas(members, vec, "row_id", N, "loo", stratified=True).withColumnRenamed("run", "variant")


@_query("loo_verdict__R18", f"""SELECT CASE WHEN mb >= 0.33 AND abs(f - mb) <= 0.10 AND least_minus >= 0.33 THEN 'robust' WHEN mb < 0.30 OR f - mb > 0.15 THEN 'dependent' ELSE 'intermediate' END AS verdict FROM (
    SELECT max(delta) FILTER (run = 'full') AS f, max(delta) FILTER (run = 'minus_' || (SELECT person FROM cited WHERE k = 1)) AS mb, min(delta) FILTER (run LIKE 'minus_%') AS least_minus FROM ({_LOO}))""", "loo_c", "cited")
def _(spark, d):
    circle, _centre = _most_cited(spark, d)
    return probe.dependence(_Q["leave_one_out__R16_G3_G5"](spark, d), "variant", circle[0] if circle else "")


_SETS = {"all": SEEDS, "absence": ["ausencia", "ausente", "silencio", "olvido"], "writing": ["escritura", "escribir", "escrito", "escrita"], "death": ["muerte", "soledad", "imposible"]}
_CTE["swk"] = f"""SELECT run, unnest(list_filter([CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END, CASE WHEN NOT a AND NOT b THEN 'd' END], lambda x: x IS NOT NULL)) AS kind, row_id FROM (
    SELECT row_id, run, a, in_b OR in_c AS b FROM ({" UNION ALL ".join(f"SELECT row_id, '{k}' AS run, regexp_matches(text, '{_TERMS(v)}') AS a FROM par" for k, v in _SETS.items())}) JOIN gv USING (row_id))"""


@_query("seed_set_sweep__R20", _deltas_sql("sw", "swk", "sweep"), "sw_c")
def _(spark, d):
    """The probe for several seed sets, each drawn by the same keys."""
    circle, centre = _most_cited(spark, d)
    df, vec = _with_vectors(spark, d, corpus.paragraphs(spark, d, "text", "persons"))
    b = F.arrays_overlap("persons", F.array(*map(F.lit, circle)).cast("array<string>")) | F.array_contains("persons", centre or "")
    flags = df.select("row_id", b.alias("b"), F.explode(F.array(*[F.struct(F.lit(k).alias("run"), T.has_term(F.col("text"), v).alias("a")) for k, v in _SETS.items()])).alias("s"))
    flags = cut(flags.select("row_id", "b", "s.run", "s.a"), "sets")
    kind = F.explode(F.array_compact(F.array(F.when(F.col("a"), "a"), F.when(F.col("b"), "b"), F.when(~F.col("a") & ~F.col("b"), "d"))))
    return probe.deltas(flags.select("run", kind.alias("kind"), "row_id"), vec, "row_id", N, "sweep")


_CTE["cty"] = "SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS k FROM lp GROUP BY item"
_CTE["vocab"] = f"SELECT 'seeds' AS run, unnest([{', '.join(repr(x) for x in SEEDS)}]) AS item UNION ALL SELECT 'second', item FROM cty WHERE k BETWEEN 41 AND 44 UNION ALL SELECT 'third', item FROM cty WHERE k BETWEEN 61 AND 66"
_CTE["signers"] = "SELECT 'seeds' AS run, person FROM circle UNION ALL SELECT 'second', person FROM cited WHERE k BETWEEN 9 AND 11 UNION ALL SELECT 'third', person FROM cited WHERE k BETWEEN 12 AND 13"
_CTE["dosa"] = "SELECT DISTINCT run, row_id FROM vocab JOIN lp USING (item) SEMI JOIN gv USING (row_id)"
_CTE["dosb"] = "SELECT DISTINCT run, row_id FROM signers JOIN pp USING (person) SEMI JOIN gv USING (row_id)"
_CTE["dosk"] = "SELECT run, 'a' AS kind, row_id FROM dosa UNION ALL SELECT run, 'b', row_id FROM dosb UNION ALL SELECT run, 'd', row_id FROM (SELECT run, row_id FROM (SELECT DISTINCT run FROM vocab), gv) ANTI JOIN (FROM dosa UNION ALL FROM dosb) USING (run, row_id)"
_ONCE |= {"dosa", "dosb"}


@_query("dossiers__A25_G4", f"""SELECT run AS dossier, n_a, coalesce(n_b, 0) AS n_b, n_ab, n_ad, delta, dispersion, dominant, matched_vocab, matched_authors FROM ({_deltas_sql("dos", "dosk", "dossiers")}) JOIN (SELECT run, count(*) AS n_a FROM dosa GROUP BY run) USING (run) LEFT JOIN (SELECT run, count(*) AS n_b FROM dosb GROUP BY run) USING (run)
    JOIN (SELECT run, round(max(k) / sum(k), 6) AS dispersion, arg_max(issue, (k, issue)) AS dominant FROM (SELECT run, issue, count(*) AS k FROM dosa JOIN par USING (row_id) WHERE issue IS NOT NULL GROUP BY ALL) GROUP BY run) USING (run)
    JOIN (SELECT run, string_agg(item, '|' ORDER BY item) AS matched_vocab FROM vocab SEMI JOIN lp USING (item) GROUP BY run) USING (run) JOIN (SELECT run, string_agg(person, '|' ORDER BY person) AS matched_authors FROM signers SEMI JOIN pp USING (person) GROUP BY run) USING (run)""", "dosk", "dos_c", "vocab", "signers", "par", "lp", "pp")
def _(spark, d):
    """Dossiers of lemmas and people: the probe with D as all rows in neither A nor B, and how A spreads over issues."""
    lem, ppl = _lemmas(spark, d), _people(spark, d)
    common = [r[0] for r in lem.groupBy("item").count().orderBy(F.desc("count"), "item").limit(66).collect()]
    cited = [r[0] for r in ppl.groupBy("person").count().orderBy(F.desc("count"), "person").limit(13).collect()]
    dossiers = {"seeds": (SEEDS, cited[:7]), "second": (common[40:44], cited[8:11]), "third": (common[60:66], cited[11:13])}
    p, vec = _with_vectors(spark, d, corpus.paragraphs(spark, d, "issue"))
    return probe.dossiers(cut(p.select("row_id", "issue"), "rows"), lem, ppl.withColumnRenamed("person", "item"), vec, dossiers, "row_id", N, "dossiers")


_CTE["thickest"] = "SELECT text_id FROM (SELECT text_id, count(*) AS n FROM par WHERE text_id IS NOT NULL GROUP BY text_id) ORDER BY n DESC, text_id LIMIT 1"
_CTE["tissue"] = "SELECT arg_max(issue, (n, issue)) AS issue FROM (SELECT issue, count(*) AS n FROM par JOIN thickest USING (text_id) WHERE issue IS NOT NULL GROUP BY issue)"


@_query("dossier_rates__G6_A10", """SELECT part, count(*) AS n, round(avg(in_a::INT), 6) AS rate FROM (SELECT unnest(list_filter([CASE WHEN p.text_id = (FROM thickest) THEN 'dossier' WHEN p.issue = (FROM tissue) THEN 'issue_rest' END, CASE WHEN p.text_id IS DISTINCT FROM (FROM thickest) AND NOT in_b THEN 'rest' END], lambda x: x IS NOT NULL)) AS part, in_a FROM par p JOIN grp USING (row_id)) GROUP BY part""", "par", "grp", "thickest", "tissue")
def _(spark, d):
    """How often the lexicon stands in the longest text, in the rest of its issue, and in the rest of the corpus without B."""
    g = cut(_grouped(spark, d, "text_id", "issue").select("row_id", "text_id", "issue", "in_a", "in_b"), "grouped")
    first = g.filter("text_id IS NOT NULL").groupBy("text_id").count().orderBy(F.desc("count"), "text_id").first()
    text = first["text_id"] if first else None
    of = g.filter((F.col("text_id") == text) & F.col("issue").isNotNull()).groupBy("issue").count().orderBy(F.desc("count"), F.desc("issue")).first()
    parts = groups.dossier_parts(g, F.col("text_id").eqNullSafe(text) & F.col("text_id").isNotNull(), F.col("issue") == (of["issue"] if of else None), F.col("in_b"))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(F.col("in_a").cast("int")), 6).alias("rate"))


def _shared_test(spark, d, column: str) -> DataFrame:
    """All pairs of a query row and any other that share a value, against all pairs of a query row and any other."""
    c = pairs.shared_counts(cut(_pair_rows(spark, d), "rows"), _asked(), column)
    return probe.counted_table(c, "shared", "base")


def _shared_test_sql(column: str) -> str:
    c = f"SELECT round({_DOT}(a.vec, b.vec), 4) AS cos, list_has_any(a.{column}, b.{column}) AS shared FROM pr a JOIN pr b ON a.row_id % 100 = 0 AND a.row_id <> b.row_id AND NOT (b.row_id % 100 = 0 AND b.row_id < a.row_id)"
    both = "SELECT 'shared' AS class, cos FROM sc WHERE shared UNION ALL SELECT 'base', cos FROM sc"
    d_ = _delta_sql("SELECT 1 AS run, cos, class = 'shared' AS is_x FROM b")
    return f"WITH sc AS MATERIALIZED ({c}), b AS ({both}), dl AS ({d_}) SELECT class, count(*) AS n_pairs, round(quantile_cont(cos, 0.5), 6) AS median, round(quantile_cont(cos, 0.25), 6) AS iqr_low, round(quantile_cont(cos, 0.75), 6) AS iqr_high, CASE WHEN class = 'base' THEN 0 ELSE max(delta) END AS delta FROM b, dl GROUP BY class"


@_query("shared_people_test__R13", f"FROM ({_shared_test_sql('persons')})", "pr")
def _(spark, d):
    return _shared_test(spark, d, "persons").drop("p")


@_query("shared_concept_test__R13", f"FROM ({_shared_test_sql('lemmas')})", "pr")
def _(spark, d):
    return _shared_test(spark, d, "lemmas").drop("p")


@_query("shared_people_pairs__J3", "SELECT least(a.row_id, b.row_id) AS i, greatest(a.row_id, b.row_id) AS j, count(*) AS shared FROM pp a JOIN pp b USING (person) WHERE a.row_id % 100 = 0 AND a.row_id <> b.row_id AND NOT (b.row_id % 100 = 0 AND b.row_id < a.row_id) GROUP BY ALL", "pp")
def _(spark, d):
    """Every pair of a query row and any other that cites a common person, once, with how many they share."""
    return postings.shared_item_pairs(_people(spark, d).select("row_id", "person"), "row_id", "person", asks=F.col("i") % 100 == 0)


_CTE["gc"] = f"SELECT round({_DOT}(a.vec, b.vec), 9) AS cos, round(coalesce(len(list_intersect(a.lemmas, b.lemmas)) / nullif(len(list_distinct(list_concat(a.lemmas, b.lemmas))), 0), 0), 9) AS jac FROM ({_cross_sql(_placed_sql(' UNION ALL '.join(f'SELECT {chr(39)}all{chr(39)} AS run, {s} AS side, row_id FROM pr' for s in (0, 1)), 'graded'), 'graded', N_GRADED)}) p JOIN pr a ON a.row_id = i JOIN pr b ON b.row_id = j"
_BINS = [(-0.001, 0.0, "0"), (0.0, 0.1, "(0, 0.1]"), (0.1, 0.2, "(0.1, 0.2]"), (0.2, 0.4, "(0.2, 0.4]"), (0.4, 1.01, "(0.4, 1]")]


def _graded(spark, d) -> DataFrame:
    rows = cut(_pair_rows(spark, d), "rows")
    both = rows.select(F.lit("all").alias("run"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "row_id")
    at = sampling.cross_pairs(both, "row_id", N_GRADED, "graded")
    x, y = rows.select(F.col("row_id").alias("i"), F.col("vec").alias("x"), F.array_distinct("lemmas").alias("p")), rows.select(F.col("row_id").alias("j"), F.col("vec").alias("y"), F.array_distinct("lemmas").alias("q"))
    return at.join(x, "i").join(y, "j").select(F.round(vectors.dot(F.col("x"), F.col("y")), 9).alias("cos"), F.round(T.jaccard(F.col("p"), F.col("q")), 9).alias("jac"))


_MID = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"


@_query("graded_coherence__R14_R17_A18_O3", f"SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT {_MID('cos')} AS a, {_MID('jac')} AS b FROM gc)", "pr", "gc")
def _(spark, d):
    return rankstats.spearman(_graded(spark, d), "cos", "jac").select("n", F.round("rho", 6).alias("rho"))


@_query("cosine_by_overlap__A15", "SELECT CASE " + " ".join(f"WHEN jac > {a} AND jac <= {b} THEN '{n}'" for a, b, n in _BINS) + " END AS bin, count(*) AS n, round(quantile_cont(cos, 0.5), 6) AS median FROM gc GROUP BY ALL", "pr", "gc")
def _(spark, d):
    return figures.binned_medians(_graded(spark, d), "jac", "cos", _BINS)


_COHERENT = f"(SELECT delta FROM ({_shared_test_sql('lemmas')}) WHERE class = 'shared'), (SELECT corr(a, b) AS rho FROM (SELECT {_MID('cos')} AS a, {_MID('jac')} AS b FROM gc))"


@_query("coherence_verdict__R18", f"SELECT CASE WHEN delta >= 0.33 THEN 'strong' WHEN delta >= 0.15 THEN 'modest' ELSE 'none' END AS strength, CASE WHEN rho >= 0.15 THEN 'tracks' WHEN rho >= 0.05 THEN 'weak' ELSE 'none' END AS graded FROM {_COHERENT}", "pr", "gc")
def _(spark, d):
    delta = _Q["shared_concept_test__R13"](spark, d).filter("class = 'shared'").select("delta")
    rho = rankstats.spearman(_graded(spark, d), "cos", "jac").select("rho")
    return delta.join(rho).select(*probe.coherence(F.col("delta"), F.col("rho")))


# --- pair mining --------------------------------------------------------------------------------------------------

_HOT = lambda name, cond, order: f"(SELECT '{name}' AS direction, i, j, round(e_cos, 4) AS e_cos, round(c_jaccard, 4) AS c_jaccard, shared_lemmas, h_shared FROM el WHERE {cond} ORDER BY el.e_cos {order}, i, j LIMIT 200)"


@_query("hotspots__J4_J5_O5_G7", f"SELECT * FROM {_HOT('E_high_surface_zero', 'shared_lemmas = 0 AND h_shared = 0', 'DESC')} UNION ALL SELECT * FROM {_HOT('C_high_E_low', 'shared_lemmas >= 3', 'ASC')}", "el")
def _(spark, d):
    return pairs.hotspots(cut(_pair_rows(spark, d), "rows"), _asked())


@_query("scale_statistics__A14", """SELECT count(*) AS n_eligible, round(avg(e_cos), 3) AS mean_all, count_if(m1) AS d1_pool, round(count_if(m1) / count(*), 3) AS d1_share, round(avg(e_cos) FILTER (m1), 3) AS d1_mean, round(stddev_pop(e_cos) FILTER (m1), 3) AS d1_sd,
    count_if(m1 AND e_cos > 0.5) AS d1_gt05, count_if(m1 AND e_cos > 0.6) AS d1_gt06, count_if(m1 AND e_cos > 0.7) AS d1_gt07, round(quantile_cont(round(e_cos, 4), 0.999) FILTER (m1), 3) AS d1_p999, round(quantile_cont(round(e_cos, 4), 0.9999) FILTER (m1), 3) AS d1_p9999, count_if(m2) AS d2_pool, round(count_if(m2) / count(*), 4) AS d2_share, round(avg(e_cos) FILTER (m2), 3) AS d2_mean, round(stddev_pop(e_cos) FILTER (m2), 3) AS d2_sd,
    count_if(m2 AND e_cos < 0.25) AS d2_lt025, count_if(m2 AND e_cos < 0.3) AS d2_lt03 FROM (SELECT *, shared_lemmas = 0 AND h_shared = 0 AS m1, shared_lemmas >= 3 AS m2 FROM el)""", "el")
def _(spark, d):
    return pairs.scale(cut(_pair_rows(spark, d), "rows"), _asked())


@_query("pair_correlations__A18", " UNION ALL ".join(f"SELECT '{name}' AS other, count(*) AS n, round(CASE WHEN NOT isnan(corr(a, b)) THEN corr(a, b) END, 4) AS rho FROM (SELECT {_MID('e')} AS a, {_MID('o')} AS b FROM (SELECT round(e_cos, 4) AS e, {other} AS o FROM el))" for name, other in (("c_jaccard", "round(c_jaccard, 9)"), ("h_shared", "(h_shared > 0)::INT"))), "el")
def _(spark, d):
    """Rank correlation of the cosine, at four digits, with the overlap of items and with whether people are shared."""
    c = cut(pairs.value_counts(cut(_pair_rows(spark, d), "rows"), _asked()), "counts")
    two = F.explode(F.array(F.struct(F.lit("c_jaccard").alias("other"), F.col("c_jaccard").alias("_y")), F.struct(F.lit("h_shared").alias("other"), F.col("h").cast("double").alias("_y")))).alias("s")
    pair = c.select(F.col("e_cos").alias("_x"), "n", two).groupBy("s.other", "_x", "s._y").agg(F.sum("n").alias("_n"))
    return rankstats.spearman_of_counts(pair, ["other"]).select("other", "n", F.round("rho", 4).alias("rho"))


_NB = "SELECT a.row_id AS i, b.row_id AS j, len(a.lemmas) AS ni, round(list_dot_product(a.vec, b.vec), 9) AS e, len(list_intersect(a.lemmas, b.lemmas)) / (len(a.lemmas) + len(b.lemmas) - len(list_intersect(a.lemmas, b.lemmas))) AS c FROM pr a JOIN pr b ON a.row_id % 100 = 0 AND a.row_id <> b.row_id AND a.text_id IS DISTINCT FROM b.text_id"


@_query("neighbour_agreement__O6_O7", f"SELECT i AS row_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) AS neigh_jaccard FROM (SELECT i, list(j) FILTER (re <= 10) AS x, list(j) FILTER (rc <= 10) AS y, count(*) AS n FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY e DESC, j) AS re, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS rc FROM ({_NB} WHERE len(a.lemmas) > 0 AND len(b.lemmas) > 0)) GROUP BY i) WHERE n >= 10", "pr")
def _(spark, d):
    return pairs.neighbourhoods(cut(_pair_rows(spark, d), "rows"), _asked())


_OUTSIDE = f"SELECT i, j, round(e, 6) AS e_cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY e DESC, j) AS rank FROM (SELECT a.row_id AS i, b.row_id AS j, round(list_dot_product(a.vec, b.vec), 9) AS e FROM pr a JOIN pr b ON a.row_id % 100 = 0 AND a.text_id IS DISTINCT FROM b.text_id)) WHERE rank <= 5"


@_query("nearest_outside__O8", _OUTSIDE, "pr")
def _(spark, d):
    return pairs.neighbours_outside(cut(_pair_rows(spark, d), "rows"), _asked())


@_query("neighbour_tally__A33", f"SELECT contributor, count(*) AS n FROM ({_OUTSIDE}) JOIN (SELECT row_id AS j, contributor FROM par) USING (j) GROUP BY contributor ORDER BY n DESC, contributor NULLS FIRST LIMIT 8", "pr", "par")
def _(spark, d):
    n = pairs.neighbours_outside(cut(_pair_rows(spark, d), "rows"), _asked())
    return n.join(corpus.paragraphs(spark, d, "contributor").select(F.col("row_id").alias("j"), "contributor"), "j").groupBy("contributor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "contributor").limit(8)


# --- nulls --------------------------------------------------------------------------------------------------------

_RUNS = f"(SELECT unnest(range({RUNS})) AS run)"
_CTE["nlk"] = f"SELECT run, row_id, CASE WHEN p <= na THEN 'a' WHEN p <= na + nb THEN 'b' ELSE 'd' END AS kind FROM (SELECT run, row_id, row_number() OVER (PARTITION BY run ORDER BY md5('shuffle|' || run || '|' || row_id)) AS p FROM gv, {_RUNS}), (SELECT count_if(in_a) AS na, count_if(in_b) AS nb FROM gv)"
_NULL = _deltas_sql("nl", "nlk", "null")


@_query("label_null__R4", _NULL, "nl_c")
def _(spark, d):
    """Fake groups as large as the real A and B, all other rows being D."""
    g, vec = _with_vectors(spark, d, _grouped(spark, d))
    g = cut(g.select("row_id", "in_a", "in_b"), "grouped")
    n = g.agg(F.count_if("in_a").alias("a"), F.count_if("in_b").alias("b")).first()
    return probe.deltas(resample.shuffled_labels(g, "row_id", n["a"], n["b"], RUNS, "shuffle"), vec, "row_id", N, "null")


_SUMMARY = "count(delta) AS n_runs, round(avg(delta), 6) AS mean, round(stddev_pop(delta), 6) AS sd, round(quantile_cont(delta, 0.05), 6) AS low, round(quantile_cont(delta, 0.95), 6) AS high"


@_query("null_verdict__R18", f"SELECT {_SUMMARY}, round(median(abs(delta)), 6) AS median_abs, CASE WHEN median(abs(delta)) < 0.05 THEN 'passes' WHEN median(abs(delta)) > 0.1 THEN 'fails' ELSE 'marginal' END AS verdict FROM ({_NULL})", "nl_c")
def _(spark, d):
    return probe.null_summary(cut(_Q["label_null__R4"](spark, d), "null"))


def _matched_sql(name: str, targets: str, pool: str, nearest: int, seed: str) -> None:
    """CTE `name` (run, item): an item drawn per run from the pool matched to each target, as `resample` does it."""
    band = f"SELECT target, item FROM {targets} t JOIN {pool} p ON p.n >= t.n * 0.5 AND p.n <= t.n * 2"
    near = f"SELECT target, item FROM (SELECT target, item, row_number() OVER (PARTITION BY target ORDER BY abs(p.n - t.n), item) AS r FROM (SELECT * FROM {targets} ANTI JOIN ({band}) USING (target)) t, {pool} p)" + (f" WHERE r <= {nearest}" if nearest else "")
    _CTE[name] = f"SELECT run, item FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY item) - 1 AS place, count(*) OVER (PARTITION BY target) AS size FROM ({band} UNION ALL {near})), {_RUNS} WHERE place = ('0x' || substr(md5('{seed}|' || run || '|' || target), 1, 8))::BIGINT % size"
    _ONCE.add(name)


_CTE["tokn"] = "SELECT item, count(*) AS n FROM tok GROUP BY item"
_CTE["lext"] = f"SELECT target, coalesce(n, 0) AS n FROM (SELECT unnest([{', '.join(repr(x) for x in SEEDS)}]) AS target) LEFT JOIN tokn ON item = target"
_CTE["lexp"] = f"SELECT * FROM tokn WHERE item NOT IN (SELECT word FROM function_words) AND item NOT IN ({', '.join(repr(x) for x in SEEDS)})"
_CTE["aut"] = "SELECT person AS target, count(*) AS n FROM pp SEMI JOIN circle USING (person) GROUP BY person"
_CTE["aup"] = "SELECT person AS item, count(*) AS n FROM pp WHERE person NOT IN (FROM circle UNION ALL FROM centre) GROUP BY person HAVING count(*) >= 5"
_ONCE |= {"tokn", "lexp", "aup"}
_matched_sql("lexd", "lext", "lexp", 50, "lexicon")
_matched_sql("autd", "aut", "aup", 30, "authors")
_matched_sql("alld", "aut", "aup", 0, "authors")
_DRAWN = {"lexa": ("lexd", "tok", "item"), "auta": ("autd", "pp", "person"), "alla": ("alld", "pp", "person")}
for _name, (_draw, _post, _col) in _DRAWN.items():
    _CTE[_name] = f"SELECT DISTINCT run, row_id FROM {_draw} JOIN {_post} ON {_post}.{_col} = {_draw}.item SEMI JOIN gv USING (row_id)"
    _ONCE.add(_name)
_fixed = lambda flag: f"SELECT run, row_id FROM gv, {_RUNS} WHERE {flag}"


def _null_sql(name: str, a: str, b: str) -> str:
    _CTE[f"{name}k"] = f"SELECT run, 'a' AS kind, row_id FROM ({a}) UNION ALL SELECT run, 'b', row_id FROM ({b}) UNION ALL SELECT run, 'd', row_id FROM (SELECT run, row_id FROM gv, {_RUNS} WHERE NOT in_c) ANTI JOIN ({a} UNION ALL {b}) USING (run, row_id)"
    return _deltas_sql(name, f"{name}k", "matched")


_LEX, _AUT, _DBL = _null_sql("lx", "FROM lexa", _fixed("in_b")), _null_sql("au", _fixed("in_a"), "FROM auta"), _null_sql("db", "FROM lexa", "FROM alla")


#: The nulls by what is drawn: A of random words, B of random people (so many nearest where none is matched), or both.
_NULLS_OF = {"lexicon": (True, None), "authors": (False, 30), "both": (True, 0)}


def _nulls(spark, d, *names: str) -> DataFrame:
    """(set, run, n_ab, n_ad, delta) of the nulls: A, B or both are the rows of matched random words or people, row by row; D is what is left, without C."""
    random_a, nearest = any(_NULLS_OF[x][0] for x in names), sorted({_NULLS_OF[x][1] for x in names} - {None})
    circle, centre = _most_cited(spark, d)
    g = _grouped(spark, d, *(["text"] if random_a else []), *(["persons"] if nearest else []))
    flags = ["in_a", "in_b", "in_c"]
    g = g.select("row_id", *flags, *(["persons"] if nearest else []), *([T.words(F.col("text")).alias("tokens")] if random_a else []))
    drawn = {}
    if random_a:
        n = cut(postings.frequency(_tokens(spark, d)).withColumnRenamed("n_rows", "n"), "tokens")
        pool = n.join(table(spark, d, "function_words").select(F.col("word").alias("item")).distinct(), "item", "left_anti").filter(~F.col("item").isin(SEEDS))
        seeds = spark.createDataFrame([(s,) for s in SEEDS], "target string").join(n.withColumnRenamed("item", "target"), "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("n"))
        drawn["a"] = resample.runs_of(F.col("tokens"), resample.drawn(resample.matched_pools(seeds, pool), RUNS, "lexicon"))
    if nearest:
        n = cut(postings.frequency(_people(spark, d), "person", "n").withColumnRenamed("person", "item"), "people")
        pool = n.filter((F.col("n") >= 5) & ~F.col("item").isin([*circle, centre or ""]))
        targets = n.filter(F.col("item").isin(circle)).withColumnRenamed("item", "target")
        drawn |= {f"b_{k}": resample.runs_of(F.col("persons"), resample.drawn(resample.matched_pools(targets, pool, nearest=k), RUNS, "authors")) for k in nearest}
    sets = {x: ("a" if a else "in_a", "in_b" if k is None else f"b_{k}") for x, (a, k) in _NULLS_OF.items() if x in names}
    rows = g.join(corpus.raw_vectors(spark, d), "row_id").select(F.col("row_id").alias("key"), "vec", *flags, *[c.alias(k) for k, c in drawn.items()])
    got = held.deltas(rows, sets, flags, "in_c", RUNS, N, "matched")
    if got is not None:
        return got
    # vectors too many to be held are shuffled to the runs that draw them
    every = F.sequence(F.lit(0), F.lit(RUNS - 1))
    whole = {c: F.when(F.col(c), every).otherwise(F.array().cast("array<int>")) for c in flags}
    g, vec = _with_vectors(spark, d, g)
    g = cut(g.select("row_id", *flags, *[c.alias(k) for k, c in drawn.items()]), "grouped")
    each = lambda x, a, b: probe.deltas(cut(resample.kinds(g, "row_id", whole.get(a, F.col(a)), whole.get(b, F.col(b)), F.col("in_c"), RUNS), "kinds"), vec, "row_id", N, "matched").select(F.lit(x).alias("set"), "run", "n_ab", "n_ad", "delta")
    return reduce(DataFrame.union, [each(x, *pair) for x, pair in sets.items()])


def _null(spark, d, name: str) -> DataFrame:
    return _nulls(spark, d, name).drop("set")


@_query("lexicon_null__R5_J10_O13", _LEX, "lx_c")
def _(spark, d):
    return _null(spark, d, "lexicon")


@_query("author_null__R6_J10", _AUT, "au_c")
def _(spark, d):
    return _null(spark, d, "authors")


@_query("double_random__R7", _DBL, "db_c")
def _(spark, d):
    return _null(spark, d, "both")


_SEEN = _delta_sql("SELECT 'probe' AS run, cos, run = 'A-B' AS is_x FROM pcos WHERE run IN ('A-B', 'A-D')")


@_query("author_verdict__R18", f"SELECT {_SUMMARY}, round(avg((delta >= seen)::INT), 6) AS share_at_least, CASE WHEN any_value(seen) > quantile_cont(delta, 0.95) THEN 'special' WHEN any_value(seen) < quantile_cont(delta, 0.05) THEN 'below null' ELSE 'generic' END AS verdict FROM ({_AUT}), (SELECT delta AS seen FROM ({_SEEN}))", "au_c", "pcos")
def _(spark, d):
    seen = _Q[FLAGSHIP](spark, d).first()
    return probe.standing(cut(_Q["author_null__R6_J10"](spark, d), "null"), seen["delta"] if seen else None)


_MEAN = lambda name, q: f"(SELECT avg(delta) AS {name} FROM ({q}))"


@_query("factor_table__A31", f"SELECT delta, round(lx, 6) AS random_lexicon, round(au, 6) AS random_authors, round(db, 6) AS random_both, round(lx + au - db, 6) AS additive, round(delta - (lx + au - db), 6) AS synergy FROM ({_SEEN}), {_MEAN('lx', _LEX)}, {_MEAN('au', _AUT)}, {_MEAN('db', _DBL)}", "pcos", "lx_c", "au_c", "db_c")
def _(spark, d):
    """Means of the three nulls beside the probe: what each factor adds, and what only both together do."""
    of = {r[0]: r[1] for r in _nulls(spark, d, *_NULLS_OF).groupBy("set").agg(F.avg("delta")).collect()}
    m = lambda k: F.lit(of.get(k)).cast("double")
    seen = _Q[FLAGSHIP](spark, d).select("delta")
    both, lex, aut = m("both"), m("lexicon"), m("authors")
    r = lambda c, n: F.round(c, 6).alias(n)
    return seen.select("delta", r(lex, "random_lexicon"), r(aut, "random_authors"), r(both, "random_both"), r(lex + aut - both, "additive"), r(F.col("delta") - (lex + aut - both), "synergy"))


_CTE["cset"] = f"SELECT run, row_id, vec FROM (SELECT run, row_id, vec, row_number() OVER (PARTITION BY run ORDER BY md5('sets|' || run || '|' || row_id)) AS p FROM gv, {_RUNS} WHERE NOT in_b) WHERE p <= greatest(1, (SELECT count_if(in_c) FROM gv)) UNION ALL SELECT -1, row_id, vec FROM gv WHERE in_c"


@_query("set_null__R9", "SELECT run, round(sum(s * t) / (max(n_a) * max(n_b)), 6) AS mean_cos FROM (SELECT run, dim, sum(x) AS s, count(*) AS n_a FROM (SELECT run, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM cset) GROUP BY ALL) JOIN (SELECT dim, sum(x) AS t, count(*) AS n_b FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM gv WHERE in_b) GROUP BY ALL) USING (dim) GROUP BY run", "gv", "cset")
def _(spark, d):
    """Mean cosine to the circle of random sets as large as the C group, and as run -1 that of C."""
    g, vec = _with_vectors(spark, d, _grouped(spark, d))
    g = cut(g.select("row_id", "in_b", "in_c").join(vec, "row_id"), "grouped")
    n = max(1, g.filter("in_c").count())
    sets = resample.random_sets(g.filter("NOT in_b").select("row_id", "vec"), "row_id", n, RUNS, "sets").select("run", "vec")
    both = sets.union(g.filter("in_c").select(F.lit(-1).alias("run"), "vec"))
    return vectors.mean_cross_cosine(both, g.filter("in_b"), by=["run"]).select("run", F.round("mean_cos", 6).alias("mean_cos"))


_CTE["labelled"] = "SELECT p.row_id, p.ana_gold AS labels, v.vec, list_distinct(l.lemmas) AS open, list_intersect(list_distinct(list_transform(l.lemmas, lambda x: 'ana_' || x)), (SELECT list(label) FROM labs)) AS closed FROM par p JOIN vec v USING (row_id) JOIN lay l USING (row_id) WHERE len(p.ana_gold) > 0"
_JAC = lambda c: f"round(coalesce(len(list_intersect(a.{c}, b.{c})) / nullif(len(list_distinct(list_concat(a.{c}, b.{c}))), 0), 0), 4)"
_CTE["lpair"] = f"SELECT a.row_id AS i, b.row_id AS j, list_has_any(a.labels, b.labels) AS same, unnest([{{'layer': 'E', 'v': round({_DOT}(a.vec, b.vec), 4)}}, {{'layer': 'C-open', 'v': {_JAC('open')}}}, {{'layer': 'C-closed', 'v': {_JAC('closed')}}}], recursive := true) FROM labelled a JOIN labelled b ON a.row_id < b.row_id"
_CTE["lrank"] = "SELECT *, rank() OVER (PARTITION BY layer ORDER BY v) + (count(*) OVER (PARTITION BY layer, v) - 1) / 2 AS mid FROM lpair"
_CTE["lperm"] = f"SELECT run, f.row_id, d.labels FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS p FROM labelled) f JOIN (SELECT run, labels, row_number() OVER (PARTITION BY run ORDER BY md5('deal|' || run || '|' || row_id)) AS p FROM labelled, (SELECT unnest(range({N_PERM})) AS run)) d USING (p)"
_RECOVERED = "SELECT layer, count_if(same) AS n_x, count_if(NOT same) AS n_y, round(coalesce(2 * (sum(mid) FILTER (same) - count_if(same) * (count_if(same) + 1) / 2) / nullif(count_if(same)::DOUBLE * count_if(NOT same), 0) - 1, 0), 6) AS delta FROM {0} GROUP BY {1}"


@_query("label_recovery__R8_J6_J12", _RECOVERED.format("lrank", "layer"), "lrank")
def _(spark, d):
    """Whether pairs of labelled rows that share a label are more similar, in each layer: vectors, lemmas, predicted labels."""
    return evaluation.recovery(pairs.label_counts(_labelled(spark, d), "row_id", "labels"))


def _labelled(spark, d) -> DataFrame:
    """All labelled rows that have a vector, with their lemmas and predicted labels."""
    g = _evaluated(spark, d).select("row_id", F.col("ana_gold").alias("labels"), F.col("lemmas").alias("open"), F.col("predicted").alias("closed"))
    return cut(g.join(corpus.paragraphs(spark, d), "row_id").join(corpus.vectors(spark, d).select("row_id", "vec"), "row_id"), "gold")


_NULLS = "SELECT layer, run, round(coalesce(2 * (sum(mid) FILTER (s) - count_if(s) * (count_if(s) + 1) / 2) / nullif(count_if(s)::DOUBLE * count_if(NOT s), 0) - 1, 0), 6) AS delta FROM (SELECT layer, p.run, mid, list_has_any(p.labels, q.labels) AS s FROM lrank JOIN lperm p ON p.row_id = i JOIN lperm q ON q.row_id = j AND q.run = p.run) GROUP BY layer, run"


@_query("permutation_null__R8_T16", f"""SELECT layer, any_value(seen.delta) AS delta, count(*) AS n_runs, round(avg(n.delta), 6) AS null_mean, round(stddev_samp(n.delta), 6) AS null_sd, round(coalesce((any_value(seen.delta) - avg(n.delta)) / nullif(stddev_samp(n.delta), 0), 0), 3) AS z, round(avg((abs(n.delta) >= abs(seen.delta))::INT), 4) AS p
    FROM ({_NULLS}) n JOIN ({_RECOVERED.format('lrank', 'layer')}) seen USING (layer) GROUP BY layer""", "lrank", "lperm")
def _(spark, d):
    """Each layer's delta beside those of N_PERM permutations of the labels."""
    g = _labelled(spark, d)
    seen = cut(pairs.label_counts(g, "row_id", "labels"), "counts")
    ranks = evaluation.mid_ranks(seen)
    sums = pairs.shuffled_sums(g, "row_id", "labels", ranks, N_PERM, "deal")
    if sums is None:  # more labels than bits
        sums = pairs.permuted_sums(g, "row_id", resample.permuted(g, "row_id", "labels", N_PERM, "deal"), "labels", ranks, N_PERM)
    return evaluation.permutation_test(seen, sums)


@_query("sample_corpus__R10_R3", f"SELECT row_id FROM (SELECT row_id, in_d, row_number() OVER (PARTITION BY in_d ORDER BY md5('fill|' || row_id), row_id) AS k, count_if(NOT in_d) OVER () AS kept FROM grp) WHERE NOT in_d OR k <= {CAP} - kept", "grp")
def _(spark, d):
    g = cut(_grouped(spark, d).select("row_id", "in_d"), "grouped")
    return sampling.keep_and_fill(g, ~F.col("in_d"), CAP, "fill", "row_id").select("row_id")


# --- clusters and figures -----------------------------------------------------------------------------------------


@_query("kmeans__M1")
def _(spark, d):
    return cluster.kmeans(cut(corpus.vectors(spark, d).select("vec_id", "vec"), "vectors"), "vec_id")


@_query("principal_components__M2")
def _(spark, d):
    p = cluster.principal(cut(corpus.vectors(spark, d).select("vec_id", "vec"), "vectors"), "vec_id")
    return p.select("vec_id", F.round(F.abs(F.col("pc")[0]), 6).alias("pc1"), F.round(F.abs(F.col("pc")[1]), 6).alias("pc2"))


def _nearest(spark, d) -> DataFrame:
    v = cut(corpus.vectors(spark, d), "vectors")
    first = v.orderBy("vec_id").limit(16).select((F.row_number().over(ranking.W.orderBy("vec_id")) - 1).alias("cluster_id"), F.col("vec").alias("centre"))
    return cluster.nearest(v, first, "row_id")


_CTE["near"] = "SELECT row_id, first(cluster_id ORDER BY dd, cluster_id) AS cluster_id, min(dd) AS distance FROM (SELECT v.row_id, c.cluster_id, round(list_sum(list_transform(list_zip(v.vec, c.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS dd FROM vec v, (SELECT vec, row_number() OVER (ORDER BY vec_id) - 1 AS cluster_id FROM vec ORDER BY vec_id LIMIT 16) c) GROUP BY row_id"


@_query("nearest_centroid__M1", "SELECT row_id, cluster_id, round(distance, 6) AS distance FROM near", "near")
def _(spark, d):
    return _nearest(spark, d).select("row_id", "cluster_id", F.round("distance", 6).alias("distance"))


_CTE["ncell"] = "SELECT cluster_id, item, a, round(ln((a + 0.5) * (n - size - n_item + a + 0.5) / ((size - a + 0.5) * (n_item - a + 0.5))), 9) AS odds FROM (SELECT cluster_id, item, count(*) AS a FROM near JOIN lp USING (row_id) GROUP BY ALL) JOIN (SELECT item, count(*) AS n_item FROM lp GROUP BY ALL) USING (item) JOIN (SELECT cluster_id, count(*) AS size FROM near GROUP BY ALL) USING (cluster_id), tot"
_CTE["ngold"] = "SELECT cluster_id, row_id, unnest(ana_gold) AS label FROM near JOIN rec USING (row_id)"
_LIST = lambda cond, order: f"(SELECT cluster_id, string_agg(item, '; ' ORDER BY r) AS l FROM (SELECT cluster_id, item, row_number() OVER (PARTITION BY cluster_id ORDER BY {order}, item) AS r FROM ncell WHERE {cond}) WHERE r <= 10 GROUP BY ALL)"


@_query("cluster_labels__A28", f"SELECT s.cluster_id, size, coalesce(t.l, '') AS top_lemmas, coalesce(o.l, '') AS distinctive_lemmas, coalesce(n_gold, 0) AS n_gold, coalesce(gl, '') AS gold_labels FROM (SELECT cluster_id, count(*) AS size FROM near GROUP BY ALL) s LEFT JOIN {_LIST('true', 'a DESC')} t USING (cluster_id) LEFT JOIN {_LIST('a >= 3', 'odds DESC')} o USING (cluster_id) LEFT JOIN (SELECT cluster_id, count(DISTINCT row_id) AS n_gold FROM ngold GROUP BY ALL) USING (cluster_id) LEFT JOIN (SELECT cluster_id, string_agg(label || '(' || m || ')', '; ' ORDER BY m DESC, label) AS gl FROM (SELECT cluster_id, label, count(*) AS m FROM ngold GROUP BY ALL) GROUP BY ALL) USING (cluster_id)", "near", "ncell", "ngold")
def _(spark, d):
    member = cut(_nearest(spark, d).select("row_id", "cluster_id"), "member")
    gold = corpus.delivered_once(table(spark, d, "paragraphs"), "row_id", "ana_gold").select("row_id", F.explode("ana_gold").alias("label"))
    return cluster.described(member, _lemmas(spark, d), gold, "row_id", _total(spark, d))


_CTE["imap"] = _map_sql("issue", "isf")


@_query("issue_heatmap__X1_X6", "SELECT item, " + ", ".join(f"round(avg(log_odds) FILTER (issue = '{g}'), 6) AS \"{g}\"" for g in ISSUES) + " FROM imap SEMI JOIN (SELECT item FROM imap WHERE significant ORDER BY log_odds DESC, item, issue LIMIT 25) USING (item) GROUP BY item", "lp", "lf", "isf", "tot", "imap")
def _(spark, d):
    """The log odds by issue of the lemmas of the 25 strongest significant cells."""
    m = cut(_Q["concept_issue_map__A7"](spark, d), "map")
    return figures.heatmap(figures.of_leading(m, "item", 25, F.col("significant"), F.col("log_odds").desc(), F.col("item"), F.col("issue")), "item", "issue", "log_odds", ISSUES)


@_query("leading_cells__X2_X4_O9", "SELECT item, issue, log_odds, (SELECT max(abs(log_odds)) FROM imap) AS \"limit\" FROM imap WHERE significant ORDER BY log_odds DESC, item, issue LIMIT 30", "lp", "lf", "isf", "tot", "imap")
def _(spark, d):
    m = cut(_Q["concept_issue_map__A7"](spark, d), "map")
    return figures.leading(m, 30, F.col("significant"), F.col("log_odds").desc(), F.col("item"), F.col("issue")).join(figures.colour_limit(m, "log_odds")).select("item", "issue", "log_odds", "limit")


_STRONGEST = lambda way, order: f"(SELECT * FROM ({_TREND}) WHERE direction = '{way}' ORDER BY z {order}, item LIMIT 8)"


@_query("trajectories__X3", f"SELECT item, direction, unnest([{', '.join(repr(g) for g in ISSUES)}]) AS issue, unnest([{', '.join(f'share_{i}' for i in range(1, 6))}]) AS share FROM (SELECT * FROM {_STRONGEST('rising', 'DESC')} UNION ALL SELECT * FROM {_STRONGEST('falling', 'ASC')})", "lp", "lf", "par")
def _(spark, d):
    return figures.trajectories(cut(_trends(spark, d), "trends"), 8, "item", ISSUES)


@_query("bucket_bars__X5", "SELECT bucket, count(DISTINCT person) AS n_figures FROM prof WHERE dim = 'region' GROUP BY ALL", "prof")
def _(spark, d):
    return _Q["profile__A23_O12"](spark, d).filter("dim = 'region'").select("bucket", "n_figures")


_BIN = lambda x, low, high, k: f"least(floor(({x} - {low}) / (({high} - {low}) / {k})) + 1, {k})::INT"


@_query("cosine_histograms__X10", " UNION ALL ".join(f"SELECT '{part}' AS part, {_BIN('e_cos', -1.0, 1.0, k)} AS bin, count(*) AS n FROM el WHERE {cond} GROUP BY ALL" for part, k, cond in (("all", 120, "true"), ("E_high_surface_zero", 120, "shared_lemmas = 0 AND h_shared = 0"), ("C_high_E_low", 60, "shared_lemmas >= 3"))), "el")
def _(spark, d):
    return pairs.histograms(cut(_pair_rows(spark, d), "rows"), _asked())


@_query("layer_grid__X10", f"SELECT {_BIN('e_cos', -1.0, 1.0, 60)} AS bin_x, {_BIN('round(c_jaccard, 9)', 0.0, 1.0, 60)} AS bin_y, count(*) AS n FROM el GROUP BY ALL", "el")
def _(spark, d):
    return pairs.grid(cut(_pair_rows(spark, d), "rows"), _asked())


@_query("event_windows__streaming", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return counts.tumbling(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))
