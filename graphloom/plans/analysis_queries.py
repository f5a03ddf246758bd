"""Queries of text, time, statistics, evaluation, resolution and streaming operators, each beside its SQL twin where SQL has one."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import jsontext
from ..functions import text as T
from ..operators import gold as GOLD
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import resolution as R
from ..operators import stats as S
from ..operators import timeline as TL
from ..shared import Scratch
from ..sources.tables import table
from ..streaming import streams
from .graph_queries import QUERIES, SQL, query

R4 = "floor(({0}) * 10000 + 0.5) / 10000"


def r4(x: str) -> str:
    return R4.format(x)


# --- text
#: Letters, digits and underscore of any script: what the twins' word borders lie between.
_W = r"[\p{L}\p{N}_]"
_NOISE_SQL = r"j|jj|mr|mrs|ms|dr|md|smt|sri|shri|justice|hon''?ble|inspector|sub-?inspector|si|asi|constable|the|late|deceased|accused|appellant|respondent|petitioner|plaintiff|defendant"
_ONCE = r"regexp_replace({0}, '([^\p{{L}}\p{{N}}_])(" + _NOISE_SQL.replace("{", "{{") + r")([^\p{{L}}\p{{N}}_])', '\1 \3', 'g')"
_NORM = r"trim(regexp_replace(regexp_replace(" + _ONCE.format(_ONCE.format("' ' || lower(trim({0})) || ' '").replace("{0}", "{{0}}")).replace("{{0}}", "{0}") + r", '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_EVAL_ONCE = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}_])(mr|mrs|ms|dr|prof|sir|smt|justice|hon''ble|shri)\.?\s*', '\1', 'g')"


def norm_sql(column: str) -> str:
    return _NORM.replace("{0}", column)


@query("name_normalise", f"SELECT person_id, {norm_sql('name')} norm FROM person_records WHERE name IS NOT NULL")
def _(s, d):
    return table(s, d, "person_records", ["person_id", "name"]).where("name is not null").select("person_id", T.name_normalise(F.col("name")).alias("norm"))


@query("eval_normalise", r"SELECT person_id, regexp_replace(" + _EVAL_ONCE.format(_EVAL_ONCE.format("lower(trim(name))")) + r", '\s+', ' ', 'g') norm FROM person_records WHERE name IS NOT NULL")
def _(s, d):
    return table(s, d, "person_records", ["person_id", "name"]).where("name is not null").select("person_id", T.eval_normalise(F.col("name")).alias("norm"))


@query("generic_filter", f"SELECT person_id FROM (SELECT person_id, {norm_sql('name')} norm FROM person_records) WHERE norm NOT IN ('weapon', 'vehicle', 'unknown', 'n/a', 'na', 'none', 'person', 'victim', 'suspect', 'accused', 'object', 'item', '')")
def _(s, d):
    return table(s, d, "person_records", ["person_id", "name"]).where(~T.is_generic(T.name_normalise(F.col("name")))).select("person_id")


@query("identifier_filter", "SELECT DISTINCT role FROM person_records WHERE regexp_full_match(role, '[A-Za-z_][A-Za-z0-9_]*')")
def _(s, d):
    return table(s, d, "person_records", ["role"]).where(T.is_identifier(F.col("role"))).distinct()


@query("doc_prefix", "SELECT DISTINCT regexp_replace(person_id, '_[^_]*_[0-9]+$', '') doc FROM person_records")
def _(s, d):
    return table(s, d, "person_records", ["person_id"]).select(T.document_prefix(F.col("person_id")).alias("doc")).distinct()


_STOPS = "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought of in to for with on at from by about as into through during before after above below between out off over under again further then once here there when where why how all each every both few more most other some such no nor not only own same so than too very and but or if while what which who whom this that these those i me my we our you your he him his she her it its they them their show find get tell list give many"


@query("keywords", f"SELECT case_id, array_to_string(list_filter(regexp_extract_all(lower(title), '([a-z0-9\\-]+)', 1), lambda w: length(w) > 2 AND NOT list_contains(string_split('{_STOPS}', ' '), w))[1:8], ' ') kw FROM case_records")
def _(s, d):
    return table(s, d, "case_records", ["case_id", "title"]).select("case_id", F.array_join(T.keywords(F.col("title")), " ").alias("kw"))


@query("html_strip", r"SELECT doc_id, length(trim(regexp_replace(regexp_replace('<p>' || regexp_replace(text, '[<>]', '', 'g') || '</p><br/>', '<[^>]+>', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'))) n FROM documents WHERE text IS NOT NULL")
def _(s, d):
    """(doc_id, n): length of every text set as a page and stripped again."""
    page = F.concat(F.lit("<p>"), F.regexp_replace("text", "[<>]", ""), F.lit("</p><br/>"))
    return table(s, d, "documents", ["doc_id", "text"]).where("text is not null").select("doc_id", F.length(T.html_strip(page)).cast("bigint").alias("n"))


@query("bracket_strip", r"SELECT item_id, regexp_replace(text || ' [' || item_id || ']', '\s*\[[^\]]*\]', '', 'g') t FROM eval_items")
def _(s, d):
    return table(s, d, "eval_items").select("item_id", T.bracket_strip(F.concat("text", F.lit(" ["), F.col("item_id").cast("string"), F.lit("]"))).alias("t"))


@query("safe_id", "SELECT DISTINCT regexp_replace(title, '[^0-9A-Za-z_.\\-]', '_', 'g') t FROM case_records")
def _(s, d):
    return table(s, d, "case_records", ["title"]).select(T.safe_id(F.col("title")).alias("t")).distinct()


@query("csv_guard", "SELECT DISTINCT CASE WHEN regexp_matches(v, '^[=+\\-@\\t\\r]') THEN '''' || v ELSE v END v FROM (SELECT phone v FROM person_records WHERE phone IS NOT NULL)")
def _(s, d):
    return table(s, d, "person_records", ["phone"]).where("phone is not null").select(T.csv_guard(F.col("phone")).alias("v")).distinct()


@query("prefix_category", "SELECT c_mktsegment seg, CASE WHEN starts_with(c_mktsegment, 'C') THEN 'cylinder' WHEN starts_with(c_mktsegment, 'HP') THEN 'puck' ELSE 'other' END cat, count(*) n FROM customer GROUP BY 1")
def _(s, d):
    return table(s, d, "customer", ["c_mktsegment"]).groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n")).withColumn("cat", T.category_by_prefix(F.col("seg")))


_CATS_SQL = """list_sort(list_filter([CASE WHEN regexp_matches({0}, 'murder|homicide|killing|killed|honour killing') THEN 'murder' END, CASE WHEN regexp_matches({0}, 'rape|gang rape|gang-rape|sexual assault') THEN 'rape' END,
 CASE WHEN contains({0}, 'poison') THEN 'poisoning' END, CASE WHEN regexp_matches({0}, 'kidnap|abduct') THEN 'kidnapping' END, CASE WHEN regexp_matches({0}, 'robbery|robbed|loot') THEN 'robbery' END, CASE WHEN contains({0}, 'assault') THEN 'assault' END,
 CASE WHEN regexp_matches({0}, 'arson|set ablaze|set on fire|burned the body|burnt') THEN 'arson' END, CASE WHEN contains({0}, 'serial') THEN 'serial killing' END], lambda x: x IS NOT NULL))"""


def cats_sql(column: str) -> str:
    return _CATS_SQL.format(f"lower({column})")


@query("crime_canon", f"SELECT case_id, array_to_string({cats_sql('crime_type')}, '|') cats FROM case_records WHERE crime_type IS NOT NULL")
def _(s, d):
    return table(s, d, "case_records", ["case_id", "crime_type"]).where("crime_type is not null").select("case_id", F.array_join(T.crime_categories(F.col("crime_type")), "|").alias("cats"))


@query("primary_crime", f"WITH c AS (SELECT case_id, {cats_sql('crime_type')} l FROM case_records WHERE crime_type IS NOT NULL) SELECT case_id, CASE WHEN list_contains(l, 'murder') THEN 'murder' ELSE coalesce(l[1], 'none') END crime FROM c")
def _(s, d):
    return table(s, d, "case_records", ["case_id", "crime_type"]).where("crime_type is not null").select("case_id", T.primary_crime(T.crime_categories(F.col("crime_type"))).alias("crime"))


@query("role_norm", "SELECT role, CASE WHEN contains(lower(role), 'victim') THEN 'victim' WHEN contains(lower(role), 'accused') THEN 'accused' WHEN contains(lower(role), 'witness') THEN 'witness' WHEN contains(lower(role), 'officer') THEN 'officer' WHEN contains(lower(role), 'forensic') THEN 'forensic_analyst' WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(lower(role)) END norm, count(*) n FROM person_records GROUP BY 1")
def _(s, d):
    return table(s, d, "person_records", ["role"]).groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn("norm", T.role_normalise(F.col("role")))


_CRIMINAL_SQL = "murder homicide assault robbery theft kidnapping rape dowry fir ipc crpc accused convicted acquitted"


@query("criminal_filter", "WITH t AS (SELECT case_id, min(title) title FROM case_records GROUP BY 1), x AS (SELECT doc_id, lower(text[1:3000] || ' ' || coalesce(title, '')) x FROM documents LEFT JOIN t USING (case_id) WHERE text IS NOT NULL) SELECT doc_id FROM x WHERE len(list_filter(list_concat(string_split('" + _CRIMINAL_SQL + "', ' '), ['culpable homicide', 'criminal conspiracy', 'section 302', 'section 307', 'section 376', 'section 420', 'section 498']), lambda w: contains(x, w))) >= 2")
def _(s, d):
    """(doc_id): judgments with two keywords in their opening or the title of their case."""
    titles = table(s, d, "case_records", ["case_id", "title"]).groupBy("case_id").agg(F.min("title").alias("title"))
    return table(s, d, "documents", ["doc_id", "text", "case_id"]).where("text is not null").join(titles, "case_id", "left").where(T.is_criminal(F.col("text"), F.col("title"))).select("doc_id")


@query("length_filter", "SELECT source_type, count(*) FILTER (n_chars >= 100) n100, count(*) FILTER (n_chars >= 200) n200, count(*) FILTER (n_chars >= 500) n500 FROM documents GROUP BY source_type")
def _(s, d):
    """Texts a source keeps at each of the least lengths in use."""
    return table(s, d, "documents", ["source_type", "n_chars"]).groupBy("source_type").agg(*[F.count_if(F.col("n_chars") >= n).alias(f"n{n}") for n in (100, 200, 500)])


@query("location_split", "SELECT location_id, array_to_string(list_filter(list_transform(regexp_split_to_array(address, '[.;]'), lambda p: trim(regexp_replace(p, '^[^:]*:', ''))), lambda p: length(p) > 5), '|') p FROM location_records WHERE address IS NOT NULL")
def _(s, d):
    return table(s, d, "location_records", ["location_id", "address"]).where("address is not null").select("location_id", F.array_join(T.split_places(F.col("address")), "|").alias("p"))


@query("person_from_text", "SELECT doc_id, CASE WHEN regexp_extract(text, '\\b((?:Mr|Mrs|Ms|Dr|Shri|Smt)\\.? [^,.]+)', 1) <> '' THEN trim(regexp_extract(text, '\\b((?:Mr|Mrs|Ms|Dr|Shri|Smt)\\.? [^,.]+)', 1)) ELSE array_to_string(string_split(trim(text), ' ')[1:2], ' ') END p FROM documents")
def _(s, d):
    return table(s, d, "documents", ["doc_id", "text"]).select("doc_id", T.titled_person(F.col("text")).alias("p"))


@query("city_canon", "SELECT location_id, CASE WHEN contains(lower(name), 'delhi') THEN 'delhi' WHEN contains(lower(name), 'mumbai') THEN 'mumbai' WHEN contains(lower(name), 'kozhikode') THEN 'kozhikode' WHEN contains(lower(name), 'ghaziabad') THEN 'ghaziabad' WHEN contains(lower(name), 'noida') THEN 'noida' WHEN contains(lower(name), 'kolkata') THEN 'kolkata' ELSE '' END city FROM location_records WHERE name IS NOT NULL")
def _(s, d):
    return table(s, d, "location_records", ["location_id", "name"]).where("name is not null").select("location_id", T.city(F.col("name")).alias("city"))


@query("facts_section")
def _(s, d):
    """(doc_id, n): length of the facts part of each document."""
    return table(s, d, "documents", ["doc_id", "text"]).select("doc_id", F.length(T.facts_section(F.col("text"))).cast("bigint").alias("n"))


@query("node_text", "SELECT c_custkey k, 'Customer: ' || c_name || ' | c mktsegment=' || c_mktsegment t FROM customer")
def _(s, d):
    t = table(s, d, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return t.select(F.col("c_custkey").alias("k"), T.node_text(F.lit("Customer"), F.col("c_name"), F.create_map(F.lit("c_mktsegment"), F.col("c_mktsegment"))).alias("t"))


@query("render_report", "SELECT case_id, 'Case ' || case_id || ' (' || coalesce(status, 'n/a') || '): ' || title || ', ' || coalesce(crime_type, 'n/a') || '.' line FROM case_records")
def _(s, d):
    t = table(s, d, "case_records", ["case_id", "status", "title", "crime_type"])
    na = lambda c: F.coalesce(c, F.lit("n/a"))
    return t.select("case_id", F.format_string("Case %s (%s): %s, %s.", "case_id", na(F.col("status")), "title", na(F.col("crime_type"))).alias("line"))


@query("jaccard_pairs", "WITH t AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) w FROM eval_items), p AS (SELECT a.item_id x, b.item_id y, len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) j FROM t a JOIN t b ON a.item_id < b.item_id) SELECT x, y, " + r4("j") + " j FROM p WHERE j >= 0.2")
def _(s, d):
    """(x, y, j): items whose words overlap by a fifth or more, joined on the rarest four fifths of their words."""
    t = table(s, d, "eval_items").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    each = t.select("item_id", F.size("w").alias("n"), F.explode("w").alias("k"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("m", "k"))  # the words of one item
    prefix = each.join(each.groupBy("k").agg(F.count(F.lit(1)).alias("m")), "k").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(0.2 * F.col("n")) + 1).select("item_id", "k")
    a, b = prefix.select(F.col("item_id").alias("x"), "k"), prefix.select(F.col("item_id").alias("y"), "k")
    p = a.join(b, "k").where("x < y").select("x", "y").distinct()
    p = p.join(t.select(F.col("item_id").alias("x"), F.col("w").alias("u")), "x").join(t.select(F.col("item_id").alias("y"), F.col("w").alias("v")), "y")
    return p.withColumn("j", T.jaccard(F.col("u"), F.col("v"))).where("j >= 0.2").select("x", "y", T.round4(F.col("j")).alias("j"))


@query("token_subset", "SELECT DISTINCT g.name || '|' || l.name p FROM crime_type_list g, crime_type_list l WHERE g.name <> l.name AND len(list_filter(string_split(g.name, ' '), lambda x: NOT list_contains(string_split(l.name, ' '), x))) = 0")
def _(s, d):
    t = table(s, d, "crime_type_list", ["name"])
    # by a shared word instead of all against all
    w = t.select("name", F.split("name", " ").alias("w"), F.explode(F.split("name", " ")).alias("k"))
    a, b = w.select(F.col("name").alias("a"), F.col("w").alias("u"), "k"), w.select(F.col("name").alias("b"), F.col("w").alias("v"), "k")
    return a.join(b, "k").where((F.col("a") != F.col("b")) & T.subset(F.col("u"), F.col("v"))).select(F.concat_ws("|", "a", "b").alias("p")).distinct()


@query("seq_ratio_pairs")
def _(s, d):
    """(a, b, ratio): list entries of which one word is shared and the ratio is 0.6 or more."""
    t = table(s, d, "crime_type_list", ["name"]).select("name", F.explode(F.split("name", " ")).alias("k"))
    p = t.select(F.col("name").alias("a"), "k").join(t.select(F.col("name").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()
    p = p.where(T.ratio_bound(F.col("a"), F.col("b")) >= 0.6)
    return p.withColumn("ratio", T.round4(T.seq_ratio("a", "b"))).where("ratio >= 0.6")


@query("name_score")
def _(s, d):
    """Name scores of accepted candidate pairs whose nodes' values are known."""
    k = table(s, d, "kg_nodes", ["node_id", "val"])
    m = table(s, d, "match_candidates", ["a", "b", "accepted"]).where("accepted").select("a", "b").distinct()
    p = m.join(k.select(F.col("node_id").alias("a"), F.col("val").alias("x")), "a").join(k.select(F.col("node_id").alias("b"), F.col("val").alias("y")), "b")
    p = p.withColumn("u", T.name_normalise(F.col("x"))).withColumn("v", T.name_normalise(F.col("y")))
    sc = T.name_score(F.col("u"), F.col("v"), T.seq_ratio("u", "v"))
    return p.withColumn("s", sc).select("a", "b", T.round4(F.col("s.score")).alias("score"), "s.subset", "s.conflict")


@query("match_decision", "SELECT a, b, cos, name_score, " + r4("0.6 * name_score + 0.25 * least(cos, 1.0)") + " confidence, (name_score >= 0.88 AND cos >= 0.78) ok FROM match_candidates WHERE cos IS NOT NULL AND name_score IS NOT NULL")
def _(s, d):
    t = table(s, d, "match_candidates", ["a", "b", "cos", "name_score"]).where("cos is not null and name_score is not null")
    return t.select("a", "b", "cos", "name_score", T.round4(T.match_confidence(F.col("name_score"), F.col("cos"), F.lit(0.0))).alias("confidence"), ((F.col("name_score") >= 0.88) & (F.col("cos") >= 0.78)).alias("ok"))


@query("cat_match")
def _(s, d):
    """Written types against list entries: contained either way, a shared word, or a ratio of 0.7."""
    v = table(s, d, "case_records", ["crime_type"]).where("crime_type is not null").select(F.lower("crime_type").alias("v")).distinct()
    # distinct written types against all entries of the list, a reference of bounded size (40)
    return T.category_matches(v, table(s, d, "crime_type_list", ["name"]).where("name is not null").distinct())


_BARE = r"lower(trim(regexp_replace({0}, '\s*\[.*?\]', '', 'g')))"


@query("should_link_label", "SELECT m.a, m.b, CASE WHEN m.label = 'Person' AND contains(" + _BARE.format("x.val") + ", 'ajay kumar') AND contains(" + _BARE.format("y.val") + ", 'ajay kumar') THEN false WHEN m.label IN ('CrimeType', 'Location') THEN name_score >= 0.9 ELSE " + _BARE.format("x.val") + " = " + _BARE.format("y.val") + " END should FROM match_candidates m JOIN kg_nodes x ON x.node_id = m.a JOIN kg_nodes y ON y.node_id = m.b WHERE m.name_score IS NOT NULL AND x.val IS NOT NULL AND y.val IS NOT NULL")
def _(s, d):
    """(a, b, should): whether a scored pair of nodes is one thing by rule."""
    k = table(s, d, "kg_nodes", ["node_id", "val"]).where("val is not null")
    t = table(s, d, "match_candidates", ["a", "b", "label", "name_score"]).where("name_score is not null")
    t = t.join(k.select(F.col("node_id").alias("a"), F.col("val").alias("x")), "a").join(k.select(F.col("node_id").alias("b"), F.col("val").alias("y")), "b")
    return t.select("a", "b", T.should_link(F.col("label"), F.col("x"), F.col("y"), F.col("name_score")).alias("should"))


# --- arrays, maps, JSON
@query("array_ops", "SELECT case_id, array_to_string(gold.locations[1:2], '|') s, list_contains(gold.crime_types, 'murder') c, array_to_string(list_concat(gold.crime_types, ['x']), '|') k FROM gold_cases")
def _(s, d):
    t = table(s, d, "gold_cases", ["case_id", "gold"])
    return t.select("case_id", F.array_join(F.slice("gold.locations", 1, 2), "|").alias("s"), F.array_contains("gold.crime_types", "murder").alias("c"), F.array_join(F.concat("gold.crime_types", F.array(F.lit("x"))), "|").alias("k"))


@query("map_ops", "SELECT c_custkey k, c_mktsegment v, CASE WHEN c_name IS NULL THEN 1 ELSE 2 END n FROM customer")
def _(s, d):
    """A later map's value replaces an earlier one's; keys without a value are left out."""
    t = table(s, d, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    m = F.map_concat(F.create_map(F.lit("name"), F.col("c_name"), F.lit("seg"), F.lit("old")), F.create_map(F.lit("seg"), F.col("c_mktsegment")))
    return t.withColumn("m", F.map_filter(m, lambda k, v: v.isNotNull())).select(F.col("c_custkey").alias("k"), F.col("m").getItem("seg").alias("v"), F.size("m").alias("n"))


@query("map_key_union", "SELECT k, count(*) n FROM (SELECT unnest(list_distinct(json_keys(props))) k FROM events WHERE json_valid(props)) GROUP BY k")
def _(s, d):
    """(k, n): every key of the events' properties and how many have it."""
    m = F.from_json("props", "map<string,string>")
    return table(s, d, "events", ["props"]).select(F.explode(F.array_distinct(F.map_keys(m))).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("meaningful_props", "SELECT person_id, (CASE WHEN coalesce(description, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(address, '') <> '' THEN 1 ELSE 0 END) n FROM person_records")
def _(s, d):
    t = table(s, d, "person_records", ["person_id", "description", "address"])
    m = F.map_filter(F.create_map(F.lit("description"), F.col("description"), F.lit("address"), F.col("address"), F.lit("embedding"), F.lit("[1,2]")), lambda k, v: v.isNotNull() & (v != "") & (F.length(v) <= 600) & ~k.isin("embedding"))
    return t.select("person_id", F.size(m).alias("n"))


@query("pair_access", "SELECT case_id, array_to_string(list_transform(gold.persons, lambda p: p[1]), '|') names FROM gold_cases")
def _(s, d):
    return table(s, d, "gold_cases", ["case_id", "gold"]).select("case_id", F.array_join(F.transform("gold.persons", lambda p: F.try_element_at(p, F.lit(1))), "|").alias("names"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events")
def _(s, d):
    return table(s, d, "events", ["event_id", "props"]).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("json_repair")
def _(s, d):
    """(report_id, ok): payloads that read as JSON, cut-off ones after repair."""
    return table(s, d, "postmortem_reports", ["report_id", "payload"]).select("report_id", F.try_parse_json(jsontext.tolerant(F.col("payload"))).isNotNull().alias("ok"))


# --- dates
_MONTHS_SQL = "string_split('january february march april may june july august september october november december', ' ')"
_YEARS_SQL = r"list_sort(list_distinct(regexp_extract_all({0}, '\b((?:19|20)[0-9]{{2}})\b', 1)))"
_COMPATIBLE = "len(list_intersect({0}.y, {1}.y)) > 0 AND (len({0}.m) = 0 OR len({1}.m) = 0 OR len(list_intersect({0}.m, {1}.m)) > 0)"
_LADDER_SQL = "coalesce(" + ", ".join(f"try_strptime({{0}}, '{f}')" for f in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d %B %Y", "%B %Y")) + ", CASE WHEN regexp_full_match({0}, '[0-9]{{4}}') THEN try_strptime({0}, '%Y') END)"


def keys_sql(column: str) -> str:
    return f"{_YEARS_SQL.format(column)} y, list_filter({_MONTHS_SQL}, lambda m: contains(lower({column}), m)) m"


@query("timestamp_ladder", f"SELECT event_id, {_LADDER_SQL.format('timestamp')} ts FROM time_events")
def _(s, d):
    """(event_id, ts): every event through all formats of the ladder; null where none fits."""
    return table(s, d, "time_events", ["event_id", "timestamp"]).select("event_id", D.ladder(F.col("timestamp")).alias("ts"))


@query("year_month_keys", f"SELECT event_id, array_to_string(y, '|') y, array_to_string(m, '|') m FROM (SELECT event_id, {keys_sql('timestamp')} FROM time_events WHERE timestamp IS NOT NULL)")
def _(s, d):
    t = table(s, d, "time_events", ["event_id", "timestamp"]).where("timestamp is not null")
    return t.select("event_id", F.array_join(D.years(F.col("timestamp")), "|").alias("y"), F.array_join(D.months(F.col("timestamp")), "|").alias("m"))


@query("date_match", f"WITH t AS (SELECT case_id, i, {keys_sql('g')} FROM (SELECT case_id, unnest(gold.time_events) g, generate_subscripts(gold.time_events, 1) i FROM gold_cases)) SELECT a.case_id, a.i, b.i j FROM t a JOIN t b ON a.case_id = b.case_id AND a.i < b.i WHERE {_COMPATIBLE.format('a', 'b')}")
def _(s, d):
    """(case_id, i, j): annotated moments of a case that can mean the same date."""
    t = table(s, d, "gold_cases", ["case_id", "gold"]).select("case_id", F.posexplode("gold.time_events").alias("i", "g")).withColumn("i", (F.col("i") + 1).cast("bigint"))
    a, b = t.select("case_id", "i", F.col("g").alias("x")), t.select("case_id", F.col("i").alias("j"), F.col("g").alias("y"))
    return a.join(b, "case_id").where((F.col("i") < F.col("j")) & D.compatible(F.col("x"), F.col("y"))).select("case_id", "i", "j")


# --- timeline
_GAPS = "SELECT user_id, lag(event_id) OVER w from_event, event_id to_event, epoch_us(ts) - epoch_us(lag(ts) OVER w) us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _events(s, d):
    return table(s, d, "events", ["event_id", "user_id", "ts"])


@query("timeline_sorted", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def _(s, d):
    return TL.ordered(_events(s, d), "user_id", "ts", "event_id").select("user_id", "event_id", F.col("position").cast("bigint").alias("position"))


@query("timeline_gaps", f"SELECT user_id, from_event, to_event, floor(us / 3.6e9 * 100 + 0.5) / 100 gap_hours FROM ({_GAPS}) WHERE us / 3.6e9 > 0.5")
def _(s, d):
    return TL.gaps(_events(s, d), "user_id", "ts", "event_id", 0.5).select("user_id", "from_event", "to_event", (F.floor(F.col("gap_hours") * 100 + 0.5) / 100).alias("gap_hours"))


@query("timeline_inconsistencies", f"SELECT user_id, to_event, CASE WHEN us / 3.6e9 < 6 THEN 'warning' ELSE 'high' END severity FROM ({_GAPS}) WHERE us / 3.6e9 > 2")
def _(s, d):
    return TL.gaps(_events(s, d), "user_id", "ts", "event_id").select("user_id", "to_event", "severity")


@query("timeline_span", "SELECT user_id, min(ts) AS \"start\", max(ts) AS \"end\", " + r4("(epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9") + " AS hours, count(*) n_events FROM events GROUP BY user_id")
def _(s, d):
    return TL.spans(_events(s, d), "user_id", "ts").select("user_id", "start", "end", T.round4(F.col("hours")).alias("hours"), "n_events")


@query("precedes_contradictions", "SELECT a.event_id src_event, b.event_id dst_event FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id = a.event_id + 1 WHERE a.ts > b.ts")
def _(s, d):
    e = _events(s, d)
    a, b = e.select("user_id", F.col("event_id").alias("src_event")), e.select("user_id", F.col("event_id").alias("dst_event"))
    said = a.join(b, (a["user_id"] == b["user_id"]) & (F.col("dst_event") == F.col("src_event") + 1)).select("src_event", "dst_event")
    return TL.contradictions(said, e, "event_id", "ts").select("src_event", "dst_event")


_TS = f"WITH e AS (SELECT case_id, event_id, min({_LADDER_SQL.format('coalesce(timestamp, date)')}) ts FROM time_events WHERE case_id IS NOT NULL GROUP BY 1, 2), g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY case_id ORDER BY ts, event_id)) us FROM e WHERE ts IS NOT NULL)"


@query("case_timeline_full", _TS + ' SELECT e.case_id, count(*) n_events, count(e.ts) n_dated, min(e.ts) AS "start", max(e.ts) AS "end", count(*) FILTER (us > 86400000000) n_gaps, ' + r4("max(us) / 3.6e9") + " widest_hours FROM e LEFT JOIN g USING (case_id, event_id) GROUP BY 1")
def _(s, d):
    """One row a case: events, those with a date, span, gaps of more than a day and the widest one."""
    e = table(s, d, "time_events", ["case_id", "event_id", "timestamp", "date"]).where("case_id is not null")
    e = e.groupBy("case_id", "event_id").agg(F.min(D.ladder(F.coalesce("timestamp", "date"))).alias("ts"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.withColumn("us", F.when(F.col("ts").isNotNull(), us - F.lag(us).over(W.partitionBy("case_id").orderBy(F.asc_nulls_last("ts"), "event_id"))))
    span = [F.min("ts").alias("start"), F.max("ts").alias("end")]
    return e.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"), F.count("ts").alias("n_dated"), *span, F.count_if(F.col("us") > 86_400_000_000).alias("n_gaps"), T.round4(F.max("us") / 3.6e9).alias("widest_hours"))


# --- statistics
NUM = ["l_quantity", "l_extendedprice", "l_discount"]
_LONG = " UNION ALL ".join(f"SELECT l_returnflag g, '{c}' feature, {c} x FROM lineitem" for c in NUM)


def _stats_frame(s, d):
    return table(s, d, "lineitem", ["l_returnflag", *NUM])


@query("desc_stats", f"SELECT g AS l_returnflag, feature, count(x) n, {r4('avg(x)')} mean, {r4('stddev_pop(x)')} std, min(x) AS min, max(x) AS max, median(x) AS median FROM ({_LONG}) GROUP BY g, feature")
def _(s, d):
    t = S.describe(_stats_frame(s, d), NUM, ["l_returnflag"])
    return t.withColumn("mean", T.round4(F.col("mean"))).withColumn("std", T.round4(F.col("std")))


#: Student's 0.975 quantile by its expansion in powers of 1 / degrees of freedom, for the twin.
_T975 = "(1.959963984540054 + 2.372271230298562 / (n - 1) + 2.8224986157396 / ((n - 1) * (n - 1)) + 2.555849679507722 / ((n - 1.0) * (n - 1) * (n - 1)))"


@query("t_interval", f"WITH x AS (SELECT g AS l_returnflag, feature, count(x) n, avg(x) mean, stddev_samp(x) / sqrt(count(x)) sem FROM ({_LONG}) GROUP BY g, feature HAVING count(x) > 1) SELECT l_returnflag, feature, n, {r4('mean')} mean, floor((mean - sem * {_T975}) * 1000 + 0.5) / 1000 low, floor((mean + sem * {_T975}) * 1000 + 0.5) / 1000 high FROM x")
def _(s, d):
    """95 % interval of each feature's mean by return flag."""
    three = lambda c: F.floor(F.col(c) * 1000 + 0.5) / 1000
    return S.t_interval(_stats_frame(s, d), NUM, ["l_returnflag"]).select("l_returnflag", "feature", "n", T.round4(F.col("mean")).alias("mean"), three("low").alias("low"), three("high").alias("high"))


@query("corr_matrix", "SELECT 'l_quantity' a, 'l_extendedprice' b, " + r4("corr(l_quantity, l_extendedprice)") + " r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', " + r4("corr(l_quantity, l_discount)") + " FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', " + r4("corr(l_extendedprice, l_discount)") + " FROM lineitem")
def _(s, d):
    return S.correlations(_stats_frame(s, d), NUM).withColumn("r", T.round4(F.col("r")))


@query("shapiro")
def _(s, d):
    """Normality of event values by type, over the first 5 000 in order as the test is defined."""
    return S.normality(table(s, d, "events", ["event_id", "event_type", "value"]), "event_type", "value", "event_id")


@query("case_statistics", f"SELECT feature, count(x) n, {r4('avg(x)')} mean, {r4('stddev_pop(x)')} std, min(x) AS min, max(x) AS max, median(x) AS median FROM ({_LONG}) GROUP BY feature")
def _(s, d):
    """All measures of every feature, over all groups."""
    t = S.describe(_stats_frame(s, d), NUM)
    return t.withColumn("mean", T.round4(F.col("mean"))).withColumn("std", T.round4(F.col("std")))


@query("nn_distance_stats", "WITH p AS (SELECT p_brand b, p_partkey k, p_retailprice x, CAST(p_size AS DOUBLE) y FROM part), m AS (SELECT a.b, a.k, min(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y))) dist FROM p a JOIN p c ON a.b = c.b AND a.k <> c.k GROUP BY a.b, a.k) SELECT b, " + r4("avg(dist)") + " mean_dist, " + r4("stddev_pop(dist)") + " std_dist, count(*) n FROM m GROUP BY b")
def _(s, d):
    p = table(s, d, "part", ["p_brand", "p_partkey", "p_retailprice", "p_size"]).select(F.col("p_brand").alias("b"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("px"), F.col("p_size").cast("double").alias("py"))
    return S.nearest_distances(p, "b", "k", "px", "py").select("b", T.round4(F.col("mean_dist")).alias("mean_dist"), T.round4(F.col("std_dist")).alias("std_dist"), "n")


@query("point_thinning")
def _(s, d):
    """Parts of a brand thinned to points at least 50 apart."""
    p = table(s, d, "part", ["p_brand", "p_partkey", "p_retailprice", "p_size"]).select("p_brand", "p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return S.thin_points(p, "p_brand", "p_partkey", "x", "y", 50.0)


@query("shape_features", "SELECT p_partkey k, " + r4("4 * pi() * p_size / (p_retailprice * p_retailprice) * 1000") + " c, " + r4("p_size / p_retailprice") + " a FROM part")
def _(s, d):
    p = table(s, d, "part", ["p_partkey", "p_size", "p_retailprice"])
    f = S.shape_features(p.select("p_partkey", F.col("p_size").cast("double").alias("area"), F.col("p_retailprice").alias("perimeter"), F.col("p_size").cast("double").alias("width"), F.col("p_retailprice").alias("height"), F.lit(1.0).alias("hull"), F.lit(1.0).alias("major"), F.lit(0.5).alias("minor")))
    return f.select(F.col("p_partkey").alias("k"), T.round4(F.col("circularity") * 1000).alias("c"), T.round4(F.col("aspect_ratio")).alias("a"))


@query("quality_score", "SELECT p_partkey k, " + r4("least(1.0, p_size / 80.0 * 0.4 + (1 - abs(p_size / 50.0 - 0.3)) * 0.3 + least(p_retailprice / 1000, 1.0) * 0.3)") + " q FROM part")
def _(s, d):
    q = F.least(F.lit(1.0), F.col("p_size") / 80.0 * 0.4 + (1 - F.abs(F.col("p_size") / 50.0 - 0.3)) * 0.3 + F.least(F.col("p_retailprice") / 1000, F.lit(1.0)) * 0.3)
    return table(s, d, "part", ["p_partkey", "p_size", "p_retailprice"]).select(F.col("p_partkey").alias("k"), T.round4(q).alias("q"))


@query("bootstrap_ci")
def _(s, d):
    """95 % interval of the mean order value, 2 000 resamples."""
    return S.bootstrap_interval(table(s, d, "orders", ["o_orderkey", "o_totalprice"]).select("o_totalprice", "o_orderkey"), "o_totalprice")


@query("pca_projection")
def _(s, d):
    """(vec_id, x, y): stored vectors on their first two principal axes, centred, signs fixed, scaled to 1."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    t = table(s, d, "embeddings", ["vec_id", "embedding"]).where("embedding is not null").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(t).transform(t)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    sign = [1.0 if axes[abs(axes[:, i]).argmax(), i] > 0 else -1.0 for i in range(2)]
    p = model.transform(centred).select("vec_id", vector_to_array("p").alias("p")).select("vec_id", (F.col("p")[0] * sign[0]).alias("x"), (F.col("p")[1] * sign[1]).alias("y"))
    top = p.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y"))).alias("m"))
    return p.crossJoin(top).select("vec_id", (F.col("x") / F.col("m")).alias("x"), (F.col("y") / F.col("m")).alias("y"))  # one row


# --- evaluation
def _labels(s, d):
    """Two readings of the same pair: accepted, and a rule on its scores."""
    t = table(s, d, "match_candidates", ["label", "a", "b", "accepted", "name_score", "cos"]).where("accepted is not null and name_score is not null and cos is not null")
    return t.select("label", F.col("accepted").cast("int").alias("gold"), ((F.col("name_score") >= 0.85) & (F.col("cos") >= 0.85)).cast("int").alias("pred"), "name_score", "cos", "a", "b")


_LAB = "l AS (SELECT label, CAST(accepted AS INT) gold, CAST(name_score >= 0.85 AND cos >= 0.85 AS INT) pred, name_score, cos FROM match_candidates WHERE accepted IS NOT NULL AND name_score IS NOT NULL AND cos IS NOT NULL), c AS (SELECT label, count(*) FILTER (gold = 1 AND pred = 1) tp, count(*) FILTER (gold = 0 AND pred = 1) fp, count(*) FILTER (gold = 1 AND pred = 0) fn FROM l GROUP BY label)"
_PRF = f"{r4('tp * 1.0 / (tp + fp)')} AS precision, {r4('tp * 1.0 / (tp + fn)')} AS recall, {r4('2.0 * tp / (2.0 * tp + fp + fn)')} f1"


@query("prf_by_type", f"WITH {_LAB} SELECT label, tp, fp, fn, {_PRF} FROM c")
def _(s, d):
    return M.with_scores(M.confusion(_labels(s, d), ["label"], "gold", "pred").drop("tn"))


@query("micro_macro", f"WITH {_LAB}, u AS (SELECT label, tp, fp, fn FROM c UNION ALL SELECT '*', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c) SELECT label, tp, fp, fn, {_PRF} FROM u")
def _(s, d):
    return M.micro(M.confusion(_labels(s, d), ["label"], "gold", "pred"), "label").select("label", "tp", "fp", "fn", "precision", "recall", "f1")


@query("macro_average", f"WITH {_LAB}, s AS (SELECT tp, fp, fn, {_PRF} FROM c) SELECT 'macro' label, CAST(sum(tp) AS BIGINT) tp, CAST(sum(fp) AS BIGINT) fp, CAST(sum(fn) AS BIGINT) fn, {r4('avg(precision)')} AS precision, {r4('avg(recall)')} AS recall, {r4('avg(f1)')} f1 FROM s")
def _(s, d):
    """Unweighted means of the scores over labels."""
    return GOLD.macro(M.with_scores(M.confusion(_labels(s, d), ["label"], "gold", "pred").drop("tn")), "label")


@query("trial_means", f"WITH t AS (SELECT label, month(scored_at) trial, {r4('avg(CASE WHEN accepted = (name_score >= 0.85 AND cos >= 0.85) THEN 1.0 ELSE 0.0 END)')} accuracy FROM match_candidates WHERE accepted IS NOT NULL AND name_score IS NOT NULL AND cos IS NOT NULL AND scored_at IS NOT NULL GROUP BY 1, 2) SELECT label, count(*) trials, floor(avg(accuracy) * 1000 + 0.5) / 1000 accuracy_mean, floor(stddev_pop(accuracy) * 1000 + 0.5) / 1000 accuracy_sd FROM t GROUP BY 1")
def _(s, d):
    """Mean and deviation of a label's accuracy over months, each a trial."""
    t = table(s, d, "match_candidates", ["label", "accepted", "name_score", "cos", "scored_at"]).where("accepted is not null and name_score is not null and cos is not null and scored_at is not null")
    right = (F.col("accepted") == ((F.col("name_score") >= 0.85) & (F.col("cos") >= 0.85))).cast("double")
    return GOLD.over_trials(t.groupBy("label", F.month("scored_at").alias("trial")).agg(T.round4(F.avg(right)).alias("accuracy")), ["label"], ["accuracy"])


@query("date_coverage", f"WITH t AS (SELECT case_id, list_distinct(flatten(list_transform(gold.time_events, lambda g: {_YEARS_SQL.format('g')}))) g, {_YEARS_SQL.format('narrative')} f FROM gold_cases) SELECT case_id, CASE WHEN len(g) > 0 THEN {r4('len(list_intersect(g, f)) * 1.0 / len(g)')} END coverage FROM t")
def _(s, d):
    """Share of the annotated years of each case that its narrative names."""
    t = table(s, d, "gold_cases", ["case_id", "narrative", "gold"]).select("case_id", F.col("gold.time_events").alias("g"), F.array("narrative").alias("f"))
    return t.select("case_id", T.round4(GOLD.date_coverage(t, "g", "f")).alias("coverage"))


@query("mae_tolerance", "SELECT label, " + r4("avg(abs(name_score - cos))") + " mae, " + r4("avg(CASE WHEN abs(name_score - cos) <= 0.1 THEN 1.0 ELSE 0.0 END)") + ' AS "within" FROM match_candidates WHERE cos IS NOT NULL AND name_score IS NOT NULL GROUP BY label')
def _(s, d):
    t = table(s, d, "match_candidates", ["label", "cos", "name_score"]).where("name_score is not null").withColumn("tol", F.lit(0.1))
    return M.numeric_error(t, "label", "name_score", "cos", "tol").select("label", T.round4(F.col("mae")).alias("mae"), T.round4(F.col("within")).alias("within"))


@query("kappa", f"WITH {_LAB}, n AS (SELECT count(*) n, avg(CAST(gold = pred AS INT)) po, avg(gold) pg, avg(pred) pp FROM l) SELECT n, {r4('po')} po, {r4('(po - (pg * pp + (1 - pg) * (1 - pp))) / (1 - (pg * pp + (1 - pg) * (1 - pp)))')} kappa FROM n")
def _(s, d):
    return M.kappa(_labels(s, d), "gold", "pred").select("n", T.round4(F.col("po")).alias("po"), T.round4(F.col("kappa")).alias("kappa"))


@query("pairwise_f1", f"WITH {_LAB} SELECT label, {r4('CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END')} f1 FROM c")
def _(s, d):
    c = M.confusion(_labels(s, d), ["label"], "gold", "pred")
    return c.select("label", T.round4(M.ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), 1.0)).alias("f1"))


_FRONT = f"WITH {_LAB}, b AS (SELECT name_score, count(*) n, sum(gold) g FROM l GROUP BY 1) SELECT name_score, CAST(sum(n) OVER w AS BIGINT) accepted, CAST(sum(g) OVER w AS BIGINT) tp, CAST(sum(n) OVER w - sum(g) OVER w AS BIGINT) fp, {r4('sum(g) OVER w * 1.0 / sum(n) OVER w')} AS precision, {r4('sum(g) OVER w * 1.0 / (SELECT sum(g) FROM b)')} AS recall FROM b WINDOW w AS (ORDER BY name_score DESC)"


@query("threshold_frontier", _FRONT)
def _(s, d):
    return M.frontier(_labels(s, d), "name_score", F.col("gold") == 1)


@query("cumulative_pr", f"WITH {_LAB}, b AS (SELECT label, name_score, count(*) n, sum(gold) g FROM l GROUP BY 1, 2) SELECT label, name_score, CAST(sum(n) OVER w AS BIGINT) accepted, {r4('sum(g) OVER w * 1.0 / sum(n) OVER w')} AS precision, {r4('sum(g) OVER w * 1.0 / nullif(sum(g) OVER (PARTITION BY label), 0)')} AS recall FROM b WINDOW w AS (PARTITION BY label ORDER BY name_score DESC)")
def _(s, d):
    """Precision and recall of each label as the threshold falls, one row a score."""
    b = _labels(s, d).groupBy("label", "name_score").agg(F.count(F.lit(1)).alias("n"), F.sum("gold").alias("g"))
    down, whole = W.partitionBy("label").orderBy(F.desc("name_score")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy("label")
    n, g = F.sum("n").over(down), F.sum("g").over(down)
    return b.select("label", "name_score", n.alias("accepted"), T.round4(g / n).alias("precision"), T.round4(F.try_divide(g.cast("double"), F.sum("g").over(whole))).alias("recall"))


@query("tier_counts", f"WITH {_LAB} SELECT CASE WHEN name_score >= 0.9 THEN 'auto' WHEN name_score >= 0.75 THEN 'review' ELSE 'reject' END tier, count(*) n, CAST(sum(gold) AS BIGINT) g FROM l GROUP BY 1")
def _(s, d):
    tier = F.when(F.col("name_score") >= 0.9, "auto").when(F.col("name_score") >= 0.75, "review").otherwise("reject")
    return _labels(s, d).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum("gold").alias("g"))


@query("pair_counts", "SELECT label, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) pairs FROM (SELECT label, case_id, count(*) n FROM kg_nodes GROUP BY label, case_id) GROUP BY label")
def _(s, d):
    return M.pair_counts(table(s, d, "kg_nodes", ["label", "case_id"]), "label", "case_id")


@query("should_link_pairs", "SELECT label, val, count(*) * (count(*) - 1) // 2 pairs FROM (SELECT DISTINCT label, val, case_id FROM kg_nodes WHERE val IS NOT NULL) GROUP BY label, val")
def _(s, d):
    t = table(s, d, "kg_nodes", ["label", "val", "case_id"]).where("val is not null").distinct()
    n = F.count(F.lit(1))
    return t.groupBy("label", "val").agg((n * (n - 1) / 2).cast("bigint").alias("pairs"))


@query("greedy_match")
def _(s, d):
    """(case_id, tp, fp, fn): places annotated against places extracted, greedy at 0.75."""
    x = table(s, d, "location_extractions", ["case_id", "gold", "extracted"])
    low = lambda c: F.transform(c, lambda v: F.lower(F.trim(v)))
    return M.greedy_match(x.select("case_id", low("gold").alias("gold"), low("extracted").alias("extracted")), "case_id", "gold", "extracted")


@query("evaluate_text")
def _(s, d):
    """Precision, recall and F1 of extracted places over all cases."""
    x = table(s, d, "location_extractions", ["case_id", "gold", "extracted"])
    low = lambda c: F.transform(c, lambda v: F.lower(F.trim(v)))
    g = M.greedy_match(x.select("case_id", low("gold").alias("gold"), low("extracted").alias("extracted")), "case_id", "gold", "extracted")
    return M.micro(g.withColumn("kind", F.lit("Location")), "kind")


@query("date_greedy")
def _(s, d):
    """(case_id, tp, fp, fn): annotated moments of a case, in order, each against the first unused event of the case that can mean its date."""
    g = table(s, d, "gold_cases", ["case_id", "gold"]).where("case_id is not null").dropDuplicates(["case_id"]).select("case_id", F.coalesce("gold.time_events", F.array().cast("array<string>")).alias("gold"))
    e = table(s, d, "time_events", ["case_id", "event_id", "description", "timestamp", "date"]).dropDuplicates(["event_id"])
    e = e.join(g.select("case_id", F.size("gold").alias("k")), "case_id").select("case_id", "event_id", "k", F.concat_ws(" ", "description", "timestamp", "date").alias("t"))
    e = e.select("case_id", "event_id", "k", D.years(F.col("t")).alias("y"), D.months(F.col("t")).alias("m"))
    # of events with the same years and months a case can use as many as it has annotated moments
    first = F.row_number().over(W.partitionBy("case_id", "y", "m").orderBy("event_id"))
    found = e.withColumn("r", first).where("r <= k").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "y", "m"))).alias("found"))
    total = e.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    want = g.select("case_id", F.transform("gold", lambda t: F.struct(D.years(t).alias("y"), D.months(t).alias("m"))).alias("gold"))
    return M.greedy_dates(want.join(found, "case_id", "left").join(total, "case_id", "left"), "case_id", "gold", "found", "n")


@query("evaluate_real_cases", "SELECT case_id, len(list_intersect(list_distinct(list_transform(gold.crime_types, lambda x: lower(x))), list_distinct([lower(crime_type)]))) tp, len(list_distinct(gold.crime_types)) n FROM gold_cases WHERE crime_type IS NOT NULL")
def _(s, d):
    t = table(s, d, "gold_cases", ["case_id", "crime_type", "gold"]).where("crime_type is not null")
    return t.select("case_id", F.size(F.array_intersect(F.transform("gold.crime_types", lambda x: F.lower(x)), F.array(F.lower("crime_type")))).cast("bigint").alias("tp"), F.size(F.array_distinct("gold.crime_types")).cast("bigint").alias("n"))


@query("annotator_set_diff", "SELECT case_id, array_to_string(list_sort(list_filter(list_distinct(gold), lambda x: NOT list_contains(extracted, x))), '|') only_gold FROM location_extractions WHERE gold IS NOT NULL")
def _(s, d):
    return table(s, d, "location_extractions", ["case_id", "gold", "extracted"]).where("gold is not null").select("case_id", F.array_join(F.array_sort(F.array_except("gold", "extracted")), "|").alias("only_gold"))


_TOK = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: length(w) > 2 AND NOT list_contains(['the', 'of', 'a', 'an', 'near', 'at', 'in', 'district', 'region', 'new', 'and'], w)))"


@query("place_recall", "WITH t AS (SELECT " + _TOK.format("gold[1]") + " g, list_transform(extracted, lambda e: " + _TOK.format("e") + ") x FROM location_extractions WHERE gold IS NOT NULL AND len(gold) > 0) SELECT count(*) n, count(*) FILTER (len(g) > 0 AND len(list_filter(x, lambda e: len(e) > 0 AND (list_has_all(e, g) OR list_has_all(g, e)))) > 0) hits FROM t")
def _(s, d):
    """Cases, and those of which a place read out of the text contains the principal place or is contained in it."""
    t = table(s, d, "location_extractions", ["gold", "extracted"]).where((F.size("gold") > 0) & F.col("gold").isNotNull())
    hit = F.exists(F.coalesce("extracted", F.array().cast("array<string>")), lambda e: T.same_place(F.element_at("gold", 1), e))
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"))


@query("first_mention", "SELECT case_id, extracted[1] first_place FROM location_extractions WHERE len(extracted) > 0")
def _(s, d):
    return table(s, d, "location_extractions", ["case_id", "extracted"]).where(F.size("extracted") > 0).select("case_id", F.element_at("extracted", 1).alias("first_place"))


@query("agreement_report", "WITH v AS (SELECT doc_id, min(toxic) lo, max(toxic) hi, count(toxic) n FROM review_labels WHERE toxic IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING count(toxic) > 1) SELECT count(*) pairs, count(*) FILTER (lo = hi) agree FROM v")
def _(s, d):
    v = table(s, d, "review_labels", ["doc_id", "toxic"]).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"), F.count("toxic").alias("n")).where("n > 1")
    return v.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("lo") == F.col("hi")).alias("agree"))


def _two_readings(s, d):
    """Cases annotated by hand, and what the rules find in their narratives."""
    from ..providers import extract

    g = table(s, d, "gold_cases", ["case_id", "narrative", "gold"]).where("case_id is not null").dropDuplicates(["case_id"])
    found = extract(g.select(F.col("case_id").alias("doc_id"), "narrative"), "doc_id", "narrative")[0]
    of = lambda t: F.array_sort(F.collect_list(F.when(F.col("entity_type") == t, F.col("name"))))
    b = found.groupBy(F.col("doc_id").alias("case_id")).agg(F.struct(F.transform(of("Person"), lambda n: F.array(n, F.lit(None).cast("string"))).alias("persons"), of("Location").alias("locations"), of("Weapon").alias("weapons"), of("CrimeType").alias("crime_types"), of("TimeEvent").alias("time_events")).alias("b"))  # one narrative's
    return g.select("case_id", F.col("gold").alias("a")).join(b, "case_id", "left")


@query("agreement_by_type")
def _(s, d):
    """(entity_type, tp, fp, fn, f1): hand annotation against what the rules find in the narratives."""
    return GOLD.agreement(_two_readings(s, d))[0]


@query("agreement_kappas")
def _(s, d):
    """(kind, n, po, kappa) of roles and main crimes of the same two readings."""
    return GOLD.agreement(_two_readings(s, d))[1]


@query("gold_items")
def _(s, d):
    """(entity_type, n): what the annotations of postmortem documents name."""
    t = table(s, d, "postmortem_reports", ["report_id", "payload"]).select(F.col("report_id").alias("doc_key"), F.lit("postmortem").alias("source_type"), F.col("payload").alias("gold")).dropDuplicates(["doc_key"])
    return GOLD.gold_items(t).groupBy("entity_type").agg(F.sum(F.size("gold")).alias("n"))


@query("ingest_pipeline")
def _(s, d):
    """(label, n): the graph that extraction, deduplication, storing, embedding and resolution make of all documents."""
    from .. import pipeline

    docs = table(s, d, "documents", ["doc_id", "text"]).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return pipeline.ingest(s, docs, *pipeline.empty_graph(s)).nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("evaluate_attributes", f"WITH {_LAB} SELECT label, count(*) n, {r4('avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END)')} accuracy, {r4('avg(abs(name_score - cos))')} mae, {r4('avg(CASE WHEN abs(name_score - cos) <= 0.1 THEN 1.0 ELSE 0.0 END)')} within_tolerance FROM l GROUP BY label")
def _(s, d):
    """Yes-or-no attributes by accuracy, numeric ones by mean error and the share within a tolerance."""
    t = _labels(s, d)
    d_ = F.abs(F.col("name_score") - F.col("cos"))
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("n"), T.round4(F.avg((F.col("gold") == F.col("pred")).cast("double"))).alias("accuracy"), T.round4(F.avg(d_)).alias("mae"), T.round4(F.avg((d_ <= 0.1).cast("double"))).alias("within_tolerance"))


# --- vectors and resolution
@query("cosine_pairs", "SELECT a.vec_id x, b.vec_id y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def _(s, d):
    """(x, y): pairs of a label of cosine 0.3 or more, block against block."""
    t = table(s, d, "embeddings", ["vec_id", "embedding", "label"])
    t = t.select(F.col("vec_id").cast("string").alias("eid"), "label", F.col("vec_id").cast("string").alias("doc"), F.col("embedding").alias("emb"))
    p = R.candidates(t, 0.3).select(F.col("a_eid").cast("bigint").alias("a"), F.col("b_eid").cast("bigint").alias("b"))
    return p.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))


def _knn_all(s, d, label=None, k=10):
    """(q, vec_id): the k nearest rows of every vector whose id is divisible by 20."""
    t = table(s, d, "embeddings", ["vec_id", "embedding", "label"]).where("embedding is not null")
    return R.nearest(t.where("vec_id % 20 = 0"), t.where(f"label = {label}") if label is not None else t, "vec_id", "embedding", k).select("q", "vec_id")


def _knn_all_sql(label=None):
    return "SELECT q, vec_id FROM (SELECT a.vec_id q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL" + (f" AND b.label = {label}" if label is not None else "") + ") WHERE r <= 10"


@query("knn_topk", _knn_all_sql())
def _(s, d):
    return _knn_all(s, d)


@query("knn_label_filtered", _knn_all_sql(3))
def _(s, d):
    return _knn_all(s, d, 3)


def _facts(s, d):
    """(at, told, roles) by case, or by node where it has none: the values of a case with the one node that has each if no other does, and roles from the person records of its nodes' ids."""
    k = table(s, d, "kg_nodes", ["node_id", "case_id", "val"]).where("val is not null").withColumn("at", _at("case_id", "node_id"))
    said = k.where("case_id is not null").select("at", "node_id", F.lower(F.trim("val")).alias("w"), F.lit(None).cast("string").alias("role")).where("w <> ''")
    roles = table(s, d, "person_records", ["person_id", "role"]).where("person_id is not null").groupBy(F.col("person_id").alias("node_id")).agg(F.min(T.role_normalise(F.col("role"))).alias("role")).where("role is not null")
    roles = k.select("at", "node_id").join(roles, "node_id").select("at", "node_id", F.lit(None).cast("string").alias("w"), "role")
    # one shuffle: what is grouped by more than ``at`` keeps to its partitions
    each = said.unionByName(roles).repartition("at").groupBy("at", "w", F.when(F.col("w").isNull(), F.col("node_id")).alias("who")).agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi"), F.min("role").alias("role"))
    told = F.struct("w", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only"))
    return each.groupBy("at").agg(F.collect_list(F.when(F.col("w").isNotNull(), told)).alias("told"), F.map_from_entries(F.collect_list(F.when(F.col("w").isNull(), F.struct("who", "role")))).alias("roles"))


def _at(case, node):
    return F.coalesce(F.concat(F.lit("c:"), case), F.concat(F.lit("n:"), node))


def _accepted(s, d, new=None, give="pairs"):
    """Accepted pairs of graph nodes with a vector, those of whose ends the same is said in one row; vectors are compared where names may be accepted."""
    k = table(s, d, "kg_nodes", ["node_id", "label", "case_id", "val", "embedding"]).where("embedding is not null and val is not null")
    k = R.prepare(k.select(F.col("node_id").alias("eid"), "label", F.col("case_id").alias("doc"), "val", F.col("embedding").alias("emb")), "val").drop("val")
    grouped = R.name_groups(k).withColumn("at", _at("doc", "eid"))
    return R.decide(R.alike(grouped, _facts(s, d), "at", 0.78, new, ["grp"], give=give)).where("accepted")


_LINKS = "SELECT a.node_id x, b.node_id y FROM kg_nodes a JOIN kg_nodes b ON a.label = b.label AND a.val = b.val AND a.case_id <> b.case_id AND a.node_id < b.node_id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.78"


@query("resolve_links")
def _(s, d):
    """(x, y, basis, confidence): accepted pairs of a label in different cases, whatever their spelling."""
    p = _accepted(s, d).select(F.explode("ends").alias("e"), "basis", T.round4(F.col("confidence")).alias("confidence"))
    return p.select(F.col("e.a_eid").alias("x"), F.col("e.b_eid").alias("y"), "basis", "confidence")


@query("resolve_incremental")
def _(s, d):
    """New cases' nodes against all."""
    p = _accepted(s, d, F.col("doc").startswith("FIR-2024")).select(F.explode("ends").alias("e"), "basis")
    return p.select(F.col("e.a_eid").alias("x"), F.col("e.b_eid").alias("y"), "basis")


@query("resolve_summary")
def _(s, d):
    """(label, links) of resolution."""
    p = _accepted(s, d, give="count")
    return p.groupBy(F.col("a_label").alias("label")).agg(F.sum("n").alias("links"))


@query("resolve_clusters")
def _(s, d):
    """(component, n): groups of linked nodes and their sizes."""
    return R.groups(_accepted(s, d, give="stars")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query("resolution_benchmark", f"WITH {_LAB} SELECT label, count(*) pool, count(*) FILTER (pred = 1) accepted, CAST(sum(gold) AS BIGINT) should, count(*) FILTER (gold = 1 AND pred = 1) tp, {r4('count(*) FILTER (gold = 1 AND pred = 1) * 1.0 / nullif(count(*) FILTER (pred = 1), 0)')} AS precision, {r4('count(*) FILTER (gold = 1 AND pred = 1) * 1.0 / nullif(sum(gold), 0)')} AS recall FROM l GROUP BY label")
def _(s, d):
    """The pool of scored pairs of each label: accepted, should-link, both, precision and recall."""
    tp = F.count_if((F.col("gold") == 1) & (F.col("pred") == 1))
    t = _labels(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.col("pred") == 1).alias("accepted"), F.sum("gold").alias("should"), tp.alias("tp"))
    return t.withColumn("precision", T.round4(F.try_divide("tp", "accepted"))).withColumn("recall", T.round4(F.try_divide("tp", "should")))


_BRANCHES = ("Evidence", "Person", "Location", "Weapon", "Vehicle", "CrimeType")


@query("case_evidence", "SELECT case_id, " + ", ".join(f"count(DISTINCT val) FILTER (label = '{b}') n_{b.lower()}, coalesce(array_to_string(list_sort(list(DISTINCT val) FILTER (label = '{b}' AND val IS NOT NULL))[1:5], '|'), '') {b.lower()}" for b in _BRANCHES) + " FROM kg_nodes WHERE case_id IS NOT NULL GROUP BY case_id")
def _(s, d):
    """One row a case: of each of six kinds of evidence the number of distinct values and the first five of them."""
    t = table(s, d, "kg_nodes", ["case_id", "label", "val"]).where("case_id is not null")
    # each branch is reduced to its distinct values first, so no branch multiplies another
    values = t.where("val is not null").groupBy("case_id", "label", "val").agg(F.count(F.lit(1)).alias("n"))
    first = values.withColumn("r", F.row_number().over(W.partitionBy("case_id", "label").orderBy("val"))).where("r <= 5")
    counts = values.groupBy("case_id").agg(*[F.count_if(F.col("label") == b).alias(f"n_{b.lower()}") for b in _BRANCHES])
    names = first.groupBy("case_id").agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("label") == b, F.col("val")))), "|").alias(b.lower()) for b in _BRANCHES])
    out = t.select("case_id").distinct().join(counts, "case_id", "left").join(names, "case_id", "left")
    return out.select("case_id", *[F.coalesce(f"n_{b.lower()}", F.lit(0)).alias(f"n_{b.lower()}") for b in _BRANCHES], *[F.coalesce(b.lower(), F.lit("")).alias(b.lower()) for b in _BRANCHES])


@query("backfill_counts", "SELECT count(*) n, count(*) embedded FROM kg_nodes")
def _(s, d):
    from ..providers import backfill

    k = backfill(table(s, d, "kg_nodes", ["node_id", "val", "embedding"]), "val")
    return k.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("embedded"))


@query("rule_extraction")
def _(s, d):
    """(entity_type, n): entities found by rules in all documents."""
    from ..providers import extract

    return extract(table(s, d, "documents", ["doc_id", "text"]))[0].groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("rag_context")
def _(s, d):
    """(line): the ten nodes nearest to a question's vector and the patterns around them."""
    from ..providers import HashingEmbedder

    q = HashingEmbedder(64).embed(["blood stained knife"])[0].tolist()
    k = table(s, d, "kg_nodes", ["node_id", "label", "val", "case_id", "embedding"]).where("embedding is not null")
    c = T.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q]))
    return k.withColumn("c", c).orderBy(F.desc("c"), "node_id").limit(10).select(F.format_string("%s %s (%s)", "label", F.coalesce("val", "node_id"), "case_id").alias("line"))


@query("schema_description")
def _(s, d):
    """(line): the ontology of the relational views in words."""
    from ..model import LABELS, TYPES
    from ..ontology import NodeType, Ontology, RelType

    o = Ontology({n: NodeType(n, dict.fromkeys(p, "string"), "key") for n, (_, _, _, p) in LABELS.items()}, {t: RelType(t, [a], [b]) for t, (_, a, _, b, _, _) in TYPES.items()})
    return s.createDataFrame([(x,) for x in o.describe().split("\n")], "line string")


# --- streams
@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS \"start\", event_type, count(*) n FROM events GROUP BY 1, 2")
def _(s, d):
    st = streams.tumbling(streams.read(s, f"{d}/events.parquet").select("ts", "event_type"), "ts", ["event_type"], "1 hour", "60 days")
    return streams.drain(st, "complete", Scratch(s, "stream"))


@query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, min(ts) AS \"start\", count(*) n FROM k GROUP BY user_id, k.k")
def _(s, d):
    st = streams.sessions(streams.read(s, f"{d}/events.parquet").select("user_id", "ts"), "ts", "user_id", "2 hours")
    return streams.drain(st, "complete", Scratch(s, "stream"))


@query("stream_gap_state", f"SELECT user_id, count(*) n FROM ({_GAPS}) WHERE us / 3.6e9 > 2 GROUP BY user_id")
def _(s, d):
    st = streams.gap_state(streams.read(s, f"{d}/events.parquet").select("user_id", "ts"), "user_id", "ts", 2.0)
    return streams.drain(st, "append", Scratch(s, "stream")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_upsert", "SELECT user_id, arg_max(event_id, ts) event_id FROM events GROUP BY user_id")
def _(s, d):
    st = streams.read(s, f"{d}/events.parquet").select("user_id", "event_id", "ts")
    return streams.upsert_stream(st, ["user_id"], "ts", Scratch(s, "stream")).select("user_id", "event_id")
