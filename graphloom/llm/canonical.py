"""Free-entered values to the entries of a reference list, in SQL.

A reference string of at most ``k`` edits to a value shares with it, unchanged, at
least one of the ``k + 1`` segments it is cut into, shifted by at most ``k`` places
(pigeonhole). So the reference strings' segments are joined with the values'
substrings at those places by equality, the pairs are verified with the built-in
``levenshtein``, and what no pair is left for is reported through an anti-join.

Every distinct value is looked up once. Beside its name an entry is known by its
code, by its words in another order, by the abbreviation of any of its words and by
the other names given in ``ALIASES``; wrapping words (``NOISE``) are removed first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import Scratch

# Other names of offences.
ALIASES = {
    "murder": ("homicide", "homicide murder", "intentional killing", "killing", "unlawful killing", "murder of a person"),
    "attempted murder": ("attempt to murder", "attempt to commit murder", "murder attempt", "attempt at murder", "attempt murder", "attempted homicide", "attempt to kill", "tried to murder"),
    "culpable homicide": ("culpable homicide not amounting to murder", "manslaughter", "homicide not amounting to murder", "homicide culpable not amounting to murder"),
    "dowry death": ("death over dowry", "dowry related death", "death for dowry", "bride burning", "death due to dowry"),
    "rape": ("sexual assault", "forcible intercourse", "rape of a woman", "sexual assault rape"),
    "gang rape": ("rape by gang", "group rape", "rape by several persons", "rape by a group"),
    "kidnapping": ("kidnapping of person", "kidnapped person", "kidnapping of a person", "abduction", "kidnap", "unlawful abduction", "kidnapping and abduction", "forcible abduction"),
    "robbery": ("plain robbery", "mugging", "loot", "robbery without arms", "looting", "simple robbery"),
    "armed robbery": ("robbery with arms", "robbery at gunpoint", "robbery with weapon", "dacoity with arms", "robbery with firearm", "robbery under arms"),
    "burglary": ("housebreaking by night", "house breaking by night", "burglary by night", "house breaking", "housebreaking", "breaking and entering", "break in", "house break in", "burglary of a house"),
    "theft": ("stealing", "larceny", "plain theft", "simple theft", "theft of property", "petty theft"),
    "vehicle theft": ("car stolen", "theft of vehicle", "theft of a vehicle", "car theft", "motor vehicle theft", "auto theft", "theft of motor vehicle", "stolen vehicle", "theft of vehicles"),
    "extortion": ("blackmail for money", "demand for money", "extortion of money", "blackmail", "demand of ransom money", "extorting money"),
    "cheating": ("cheated complainant", "fraud by cheating", "cheated", "fraud", "deception", "swindling", "cheating and fraud", "cheating of public"),
    "forgery": ("forging of papers", "forged papers", "forging of documents", "document forgery", "forged documents", "forging documents", "falsification of documents"),
    "criminal breach of trust": ("breach of trust", "embezzlement", "misappropriation", "breach of trust criminal", "misappropriation of funds"),
    "arson": ("set fire to house", "set fire", "setting fire to house", "fire setting", "setting fire", "mischief by fire", "fire raising", "wilful fire setting"),
    "assault": ("physical attack", "common assault", "beating", "simple assault", "plain assault", "bodily attack"),
    "grievous hurt": ("grievous bodily harm", "serious injury", "causing grievous hurt", "serious hurt", "grave hurt", "serious bodily harm"),
    "domestic violence": ("dv", "violence at home", "violence in the home", "family violence", "cruelty by husband", "spousal abuse", "domestic abuse", "violence domestic"),
    "hit-and-run": ("run over and fled", "hit run", "hit and run accident", "hit and run driving", "leaving the scene of an accident", "fleeing the scene of accident"),
    "rash driving": ("reckless driving", "negligent driving", "dangerous driving", "rash and negligent driving", "driving rashly"),
    "drug trafficking": ("narcotics trafficking", "trafficking of drugs", "trafficking in drugs", "drug dealing", "narcotics", "drug peddling", "trafficking in narcotics", "trafficking drug"),
    "illegal arms possession": ("illegal possession of arms", "possession of illegal arms", "unlicensed firearm", "illegal weapon possession", "unlawful possession of arms", "illegal arms", "possession of unlicensed arms", "arms possession"),
    "cybercrime": ("cyber crime", "computer crime", "online crime", "internet crime", "cyber offence", "hacking"),
    "identity theft": ("impersonation with stolen id", "id theft", "id fraud", "theft of identity", "impersonation", "identity fraud", "stolen identity"),
    "stalking": ("persistent stalking", "following and stalking", "stalked victim", "following and harassing", "repeated following", "stalking of a woman", "persistent following"),
    "criminal intimidation": ("intimidation", "threatening", "criminal threat", "threat to life", "death threat", "intimidation criminal"),
    "rioting": ("riot", "mob violence", "unlawful assembly", "rioting mob", "public riot"),
    "human trafficking": ("trafficking of humans", "trafficking in persons", "trafficking in humans", "people trafficking", "trafficking of persons", "trafficking in human beings", "trafficking of human beings"),
    "money laundering": ("laundered proceeds", "laundered money", "laundering of money", "laundering money", "laundering of proceeds", "laundering"),
    "counterfeiting": ("fake currency", "counterfeit currency", "counterfeit notes", "fake notes", "counterfeiting of currency", "making fake currency"),
    "smuggling": ("contraband smuggling", "smuggling of goods", "contraband", "smuggling goods"),
    "criminal trespass": ("trespassing on land", "trespass on land", "trespass", "trespassing", "house trespass", "unlawful entry", "trespass criminal"),
    "bribery": ("bribe demand", "demand of bribe", "bribe taken", "taking bribe", "taking a bribe", "bribe", "giving bribe", "corruption", "accepting bribe", "illegal gratification", "taking bribes"),
    "perjury": ("false evidence on oath", "false statement on oath", "false evidence", "false testimony", "lying under oath", "giving false evidence", "lying on oath"),
    "abetment of suicide": ("abetting suicide", "abetment to suicide", "instigating suicide", "suicide abetment", "driving to suicide", "abetted suicide"),
    "acid attack": ("acid thrown on victim", "acid thrown", "attack with acid", "acid throwing", "throwing acid", "throwing of acid", "vitriolage"),
    "child abuse": ("abuse of child", "abuse of minor child", "abuse of a child", "abuse of minor", "child cruelty", "cruelty to child", "ill treatment of child", "child molestation"),
    "poisoning": ("poisoned food", "administering poison", "death by poison", "poison", "giving poison", "administration of poison", "poisoning case"),
}
# Words around an offence's name that don't name it.
NOISE = ("a case of", "case of", "alleged", "allegedly", "suspected", "offence of", "offense of", "charge of", "charges of", "under inv", "under investigation", "u/s", "us", "under section", "section", "sec", "reported", "complaint of", "fir for", "registered", "pending", "incident of", "crime of", "act of", "re", "regarding", "confirmed", "ipc", "probable", "possible", "case", "cases", "matter of", "matter")

#: Edits allowed by length of the reference string: (longest length, edits). Longer ones get the last.
EDITS = ((2, 0), (4, 1), (8, 2), (13, 3), (14, 4))


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def clean_sql(column: str) -> str:
    """SQL for the comparable form of a written value: lower case, letters and digits, single spaces, no wrapping words."""
    pattern = "|".join(sorted((w.replace("/", " ") for w in NOISE), key=len, reverse=True))
    base = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({column}), '^([^,]+),([^,]+)$', '$2 $1'), '[(\\\\[][^)\\\\]]*[)\\\\]]', ' '), '[^a-z0-9]+', ' '), ' +', ' '))"
    return f"trim(regexp_replace(regexp_replace(concat(' ', {base}, ' '), '( ({pattern})(?= ))+', ' '), ' +', ' '))"


def aliases_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, vs in ALIASES.items() for v in vs], "name string, alias string")


def _edits_sql(column: str) -> str:
    return "case " + " ".join(f"when length({column}) <= {n} then {k}" for n, k in EDITS[:-1]) + f" else {EDITS[-1][1]} end"


def map_to_list(spark: SparkSession, values: DataFrame, reference: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(record_key, entry_id): the entry of ``reference`` each value means, or 'unmatched'.

    ``values`` has ``record_key, value``; ``reference`` has ``entry_id, name, code``;
    ``aliases`` has ``name, alias``. Rows with a null key or a null or blank value give
    no row, every other row exactly one, repeated rows repeatedly. Of several entries
    the one with fewest edits wins, then the exact name, then the smaller entry_id.
    An empty reference list leaves all unmatched.
    """
    values.where("record_key is not null and trim(coalesce(value, '')) <> ''").selectExpr("record_key", "value").createOrReplaceTempView("canon_values")
    reference.selectExpr("cast(entry_id as string) entry_id", "name", "code").where("entry_id is not null").createOrReplaceTempView("canon_reference")
    (aliases if aliases is not None else aliases_frame(spark)).createOrReplaceTempView("canon_aliases")
    clean, scratch = clean_sql, Scratch(spark, "canonical")

    def view(name: str, sql: str) -> None:
        """A view over the result as written down: it is read several times, and holds distinct strings only."""
        scratch.write(spark.sql(sql))[0].createOrReplaceTempView(name)

    # every string an entry is known by: name, words in another order, other names, abbreviated words; codes apart
    view("canon_names", f"""
      with named as (
        select entry_id, {clean('name')} s, 0 p from canon_reference where name is not null
        union all
        select r.entry_id, {clean('a.alias')} s, 1 p from canon_reference r join canon_aliases a on lower(r.name) = lower(a.name)
      ), words as (select entry_id, s, p, split(s, ' ') w from named where s <> '')
      select distinct s, min(struct(p, entry_id)) over (partition by s).entry_id entry_id, min(p) over (partition by s) p from (
        select entry_id, s, p from words
        union all select entry_id, concat_ws(' ', slice(w, 2, size(w) - 1), array(w[0])), p from words where size(w) = 2
        union all select entry_id, concat_ws(' ', w[1], w[2], w[0]), p from words where size(w) = 3 and p = 0
        union all select entry_id, concat_ws(' ', w[2], w[0], w[1]), p from words where size(w) = 3 and p = 0
        union all select entry_id, concat_ws('', w), 2 from words where size(w) > 1
      )""")
    view("canon_distinct", f"""
      select value, {clean('value')} s, trim(regexp_replace(regexp_replace(lower(value), '[^a-z0-9.'']+', ' '), ' +', ' ')) dotted,
             regexp_replace(lower(value), '[^a-z0-9]', '') squeezed
      from (select distinct value from canon_values)""")
    # the code, alone or inside the value
    spark.sql("""
      with codes as (
        select value, regexp_replace(c, '[^a-z0-9]', '') c from (select value, explode(regexp_extract_all(lower(value), '([a-z]+[- ]?[0-9]+)', 1)) c from canon_distinct)
        union all select value, regexp_replace(lower(c), '([0-9]+)[^a-z0-9]+([a-z]+)', '$2$1') c from (select value, explode(regexp_extract_all(lower(value), '([0-9]+[- ]?[a-z]+)', 1)) c from canon_distinct)),
      r as (select entry_id, regexp_replace(lower(code), '[^a-z0-9]', '') c from canon_reference where code is not null and code <> '')
      select codes.value, min(r.entry_id) entry_id from codes join r on codes.c = r.c group by codes.value""").createOrReplaceTempView("canon_by_code")
    # pigeonhole: k + 1 segments of the name, equal to the value's substring at most k places off
    spark.sql(f"""
      with n as (select s, entry_id, p, length(s) len, {_edits_sql('s')} k from canon_names),
      cut as (select *, explode(sequence(0, k)) i from n)
      select s, entry_id, p, len, k, i, cast(floor(len * i / (k + 1)) as int) at, substring(s, cast(floor(len * i / (k + 1)) as int) + 1, cast(floor(len * (i + 1) / (k + 1)) - floor(len * i / (k + 1)) as int)) seg
      from cut""").createOrReplaceTempView("canon_segments")
    # a value meets the shapes of every length within reach by equality
    spark.sql(f"""
      with v as (select distinct s, length(s) len from canon_distinct where s <> ''),
      shape as (select distinct len, k, at, length(seg) seg_len from canon_segments),
      near as (select s, len, explode(sequence(greatest(1, len - {EDITS[-1][1]}), len + {EDITS[-1][1]})) rlen from v),
      probe as (
        select n.s, n.rlen, shape.k, shape.at, substring(n.s, q + 1, shape.seg_len) seg
        from near n join shape on shape.len = n.rlen and abs(n.len - n.rlen) <= shape.k
        lateral view explode(sequence(greatest(0, at - k), at + k)) t as q
        where q + seg_len <= n.len),
      pairs as (select distinct p.s, g.s r, g.entry_id, g.p, g.k from probe p join canon_segments g on p.seg = g.seg and p.at = g.at and p.rlen = g.len and p.k = g.k),
      checked as (select s, entry_id, p, r, levenshtein(s, r, k) d, k from pairs)
      select s, min(struct(d, p, entry_id)).entry_id entry_id from checked where d >= 0 group by s""").createOrReplaceTempView("canon_by_edits")
    # abbreviated words (griev. hurt, rob'y): each word of the name begins with the written one, or with its start and ends with its end;
    # they meet by the number of words and the place and beginning of the first abbreviated word, its two first letters where it has them
    start = "case when {0} like '%.%' then rtrim('.', {0}) else split({0}, chr(39))[0] end"
    spark.sql(f"""
      with w as (select value, split(trim(regexp_replace(dotted, concat('\\\\b(', '{"|".join(sorted((w.replace("/", " ") for w in NOISE), key=len, reverse=True))}', ')\\\\b'), ' ')), ' +') w
                 from canon_distinct d where (dotted like '%.%' or dotted like '%''%')),
      at as (select value, w, coalesce(array_min(filter(transform(w, (a, i) -> case when (a like '%.' and length(a) > 2) or (a like '%''%' and a not like concat(chr(39), '%')) then i end), i -> i is not null)), -1) i from w),
      v as (select value, w, i, case when i < 0 then '' else substring({start.format('w[i]')}, 1, 2) end b from at),
      n as (select entry_id, s, p, split(s, ' ') w from canon_names where p < 2),
      placed as (select entry_id, p, w, i, explode(array(substring(w[i], 1, 1), substring(w[i], 1, 2))) b from (select *, explode(sequence(0, size(w) - 1)) i from n)
                 union all select entry_id, p, w, -1, '' from n)
      select v.value, min(struct(n.p, n.entry_id)).entry_id entry_id from v join (select distinct * from placed) n on size(v.w) = size(n.w) and v.i = n.i and v.b = n.b
      where forall(zip_with(v.w, n.w, (a, b) -> coalesce(
        case when a like '%.' and length(a) > 2 then startswith(b, rtrim('.', a))
             when a like '%''%' then startswith(b, split(a, chr(39))[0]) and endswith(b, split(a, chr(39))[1])
             else levenshtein(rtrim('.', a), b) <= case when length(b) <= 4 then 1 else 2 end end, false)), x -> x)
      group by v.value""").createOrReplaceTempView("canon_by_abbreviation")
    # a code names the entry, then an abbreviation, then the nearest spelling
    view("canon_matched", """
      select value, min(struct(rank, entry_id)).entry_id entry_id from (
        select value, 0 rank, entry_id from canon_by_code
        union all select value, 1 rank, entry_id from canon_by_abbreviation
        union all select d.value, 2 rank, e.entry_id from canon_distinct d join canon_by_edits e on d.s = e.s
      ) group by value""")
    return spark.sql("""
      select v.record_key, m.entry_id from canon_values v join canon_matched m on v.value = m.value
      union all
      select v.record_key, 'unmatched' entry_id from canon_values v left anti join canon_matched m on v.value = m.value""")
