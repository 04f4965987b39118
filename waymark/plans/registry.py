"""The registered queries of the address-matching library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import phrases, similarity, text
from waymark.operators import blocks as bl
from waymark.operators import index as ix
from waymark.operators import match as mt
from waymark.operators import nearest as nr
from waymark.operators import results as rs
from waymark.plans import corpus
from waymark.plans.corpus import ADDRESSES_SQL, INPUTS_SQL, NEIGHBOURS_SQL
from waymark.plans.pipeline import Pipeline, Step
from waymark.sources import tables

# --- SQL pieces -----------------------------------------------------------------------------------


def _unaccent(x: str) -> str:
    x = f"translate({x}, '{text.MARKED}', '{text.PLAIN}')"
    for letter, plain in text.DOUBLE.items():
        x = f"replace({x}, '{letter}', '{plain}')"
    return x


def _clean_input(x: str) -> str:
    return f"trim(regexp_replace({_unaccent(f'upper({x})')}, '[^A-Z0-9]+', ' ', 'g'))"


def _clean_unicode(x: str) -> str:
    return f"trim(regexp_replace(replace(upper({x}), 'ẞ', 'SS'), '[^A-Z0-9{text.LETTERS}]+', ' ', 'g'))"


def _clean_reference(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(upper({x}), 'ẞ', 'SS'), '[\-.,;:_()!]+', ' ', 'g'), '  ', ' '))"


def _phrase_tokens(x: str) -> str:
    return f"string_split(regexp_replace(trim({x}), '[^A-Z0-9{text.LETTERS}]+', ' ', 'g'), ' ')"


def _numerics_reference(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: regexp_matches(t, '[0-9]'))"


def _numerics_input(x: str) -> str:
    return f"nullif(regexp_extract_all({x}, '[0-9]+[A-Z]?'), [])"


def _alpha(x: str) -> str:
    return f"nullif(regexp_extract_all({x}, '[A-Z]+'), [])"


def _bigrams(t: str) -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def _skips(t: str) -> str:
    return f"list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 2])"


def _standard(t: str) -> str:
    numeric = f"list_filter(range(1, len({t}) - 1), lambda i: TRY_CAST({t}[i] AS INTEGER) IS NOT NULL)"
    return f"list_concat({_bigrams(t)}, list_transform({numeric}, lambda i: {t}[i] || ' ' || {t}[i + 2]))"


def _soundex(t: str) -> str:
    """The code of a word in capitals: letters of equal codes that stand together, H and W left out, count once, vowels and other characters part them."""
    codes = f"translate(regexp_replace(substr({t}, 1, 1) || regexp_replace(substr({t}, 2), '[HW]', '', 'g'), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    for digit in "123456":
        codes = f"regexp_replace({codes}, '{digit}+', '{digit}', 'g')"
    return f"CASE WHEN regexp_matches({t}, '^[A-Z]') THEN substr({t}, 1, 1) || rpad(substr(replace(substr({codes}, 2), '0', ''), 1, 3), 3, '0') ELSE {t} END"


def _sounds(t: str) -> str:
    pair = lambda step: f"({_soundex(f'{t}[i]')}) || ' ' || ({_soundex(f'{t}[i + {step}]')})"
    numeric = f"list_filter(range(1, len({t}) - 1), lambda i: TRY_CAST({t}[i] AS INTEGER) IS NOT NULL)"
    return f"list_concat(list_transform(range(1, len({t})), lambda i: {pair(1)}), list_transform({numeric}, lambda i: {pair(2)}))"


def _grams(x: str) -> str:
    return f"list_transform(range(1, 8), lambda p: substr({x}, p, 3))"


def _crossed(a: str, b: str) -> str:
    return f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: x || ' ' || y)))"


_COMMON = "len(list_intersect({a}, {b}))::DOUBLE"
_UNION = "len(list_distinct(list_concat({a}, {b})))"


def _iou(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN len({a}) = 0 THEN 0.0 ELSE {_COMMON.format(a=a, b=b)} / {_UNION.format(a=a, b=b)} END"


def _iou_min(a: str, b: str) -> str:
    low = f"least(len(list_distinct({a})), len(list_distinct({b})))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {low} = 0 THEN 0.0 ELSE {_COMMON.format(a=a, b=b)} / {low} END"


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN len({a}) = 0 THEN 0.0 ELSE {_COMMON.format(a=a, b=b)} / len(list_distinct({a})) END"


def _list_overlap(a: str, b: str, t: float) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN len({a}) = 0 OR len({b}) = 0 THEN false ELSE {_COMMON.format(a=a, b=b)} / len({a}) >= {t} END"


def _multiset(a: str, b: str) -> str:
    low = f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)::DOUBLE"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE {low} / (len({a}) + len({b}) - {low}) END"


def _string_grams(x: str) -> str:
    return f"list_distinct(list_concat(list_transform(range(1, length({x}) + 1), lambda i: substr({x}, i, 1)), list_transform(range(1, length({x})), lambda i: substr({x}, i, 2))))"


def _ngram(a: str, b: str) -> str:
    x, y = _string_grams(a), _string_grams(b)
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} = '' AND {b} = '' THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END"


def _detail_sql(clean) -> str:
    return f"""{ADDRESSES_SQL},
cleaned AS (SELECT *, {clean('ADDRESS_LABEL')} AS addr FROM addresses),
detail AS (SELECT addr_id, addr, {_numerics_reference('addr')} AS numeric_tokens, ADDRESS_LABEL, LOCALITY_NAME AS suburb, POSTCODE, LATITUDE, LONGITUDE, STATE FROM cleaned WHERE len({_numerics_reference('addr')}) > 0)"""


DETAIL_SQL = f"""{_detail_sql(_clean_reference)},
detail_tokens AS (SELECT addr_id, {_phrase_tokens('addr')} AS t FROM detail)"""

PHRASES_SQL = {
    "standard": f"{DETAIL_SQL},\nphrase AS (SELECT addr_id, unnest({_standard('t')}) AS k FROM detail_tokens)",
    "bigram": f"{DETAIL_SQL},\nphrase AS (SELECT addr_id, unnest({_bigrams('t')}) AS k FROM detail_tokens)",
    "skipphrase": f"{DETAIL_SQL},\nphrase AS (SELECT addr_id, unnest({_skips('t')}) AS k FROM detail_tokens)",
    "soundex": f"{DETAIL_SQL},\nphrase AS (SELECT addr_id, unnest({_sounds('t')}) AS k FROM detail_tokens)",
}
_W = "string_split(k, ' ')"
PHRASES_SQL["trigram"] = f"""{DETAIL_SQL},
pairs AS (SELECT addr_id, unnest({_standard('t')}) AS k FROM detail_tokens),
phrase AS (SELECT addr_id, k FROM (SELECT addr_id, unnest({_crossed(_grams(f'{_W}[1]'), _grams(f'{_W}[2]'))}) AS k FROM pairs) WHERE length(k) >= 5)"""


def _match_sql(index: str, tokens: str, clean, numerics, cap: int, keep: str, score: str, prefilter: str | None, top_n: int = 1, keep_unmatched: bool = True, neighbours: bool = False) -> str:
    """The whole match as one statement."""
    own_phrases = {"standard": _standard, "bigram": _bigrams, "skipphrase": _skips, "soundex": _sounds, "trigram": lambda t: f"flatten(list_transform(range(1, len({t})), lambda i: {_crossed(_input_grams(f'{t}[i]'), _input_grams(f'{t}[i + 1]'))}))"}[index]
    first = f"first_rank AS (SELECT *, row_number() OVER (PARTITION BY address_id1 ORDER BY {prefilter} DESC, address_id2) AS r1 FROM scored_pre)" if prefilter else "first_rank AS (SELECT *, 1 AS r1 FROM scored_pre)"
    near = ", neighbours WHERE suburb = suburb_name AND state = state_name AND f.postcode = neighbours.postcode AND r1 <= 50" if neighbours else " WHERE r1 <= 50"
    tie = ", neighbour" if neighbours else ""
    return f"""WITH {PHRASES_SQL[index]},
{INPUTS_SQL},
{NEIGHBOURS_SQL + ',' if neighbours else ''}
own AS (SELECT address_id AS address_id1, address, {numerics('address')} AS input_numerics, {_alpha('address')} AS input_alpha_tokens FROM (SELECT address_id, {clean('address')} AS address FROM inputs)),
own_tokens AS (SELECT address_id1, string_split(address, ' ') AS t FROM own),
own_keys AS (SELECT DISTINCT address_id1, k FROM (SELECT address_id1, unnest({own_phrases('t')}) AS k FROM own_tokens)),
rare AS (SELECT k FROM phrase GROUP BY k HAVING count(*) < {cap}),
candidates AS (SELECT DISTINCT address_id1, addr_id AS address_id2 FROM own_keys JOIN phrase USING (k) WHERE k IN (SELECT k FROM rare)),
joined AS (SELECT c.*, o.address, o.input_numerics AS a, o.input_alpha_tokens AS aa, d.addr AS address_matched, d.numeric_tokens AS b, {_alpha('d.addr')} AS bb, d.suburb, d.POSTCODE AS postcode, d.STATE AS state, d.LATITUDE AS latitude, d.LONGITUDE AS longitude
 FROM candidates c JOIN own o USING (address_id1) JOIN detail d ON d.addr_id = c.address_id2),
scored_pre AS (SELECT * FROM joined WHERE {keep}),
{first},
scored AS (SELECT f.*, {score} AS similarity{', neighbour, correction' if neighbours else ''} FROM first_rank f{near}),
final AS (SELECT *, row_number() OVER (PARTITION BY address_id1 ORDER BY similarity DESC, address_id2{tie}) AS r2 FROM scored)
SELECT o.address_id1 AS address_id, o.address AS input_address, f.address_id2, f.address_matched, f.suburb, f.postcode, CAST(f.latitude AS DOUBLE) AS latitude, CAST(f.longitude AS DOUBLE) AS longitude, round(f.similarity, 6) AS similarity{', f.correction AS neighbouring_suburb_correction' if neighbours else ''}
FROM own o {'LEFT' if keep_unmatched else 'INNER'} JOIN (SELECT * FROM final WHERE r2 <= {top_n}) f USING (address_id1)"""


def _input_grams(x: str) -> str:
    return f"list_filter({_grams(x)}, lambda g: strlen(g) >= 2)"


# --- queries --------------------------------------------------------------------------------------


def _detail(spark: SparkSession, d: str) -> DataFrame:
    return ix.addresses_with_detail(corpus.addresses(spark, d))


def _flat(detail: DataFrame) -> DataFrame:
    """The reference table without arrays, in types that both engines print alike."""
    return detail.select("addr_id", "addr", F.array_join("numeric_tokens", "|").alias("numeric_tokens"), "ADDRESS_LABEL", "suburb", "POSTCODE", F.col("LATITUDE").cast("double").alias("LATITUDE"), F.col("LONGITUDE").cast("double").alias("LONGITUDE"), "STATE")


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Inputs and the reference table as files, which is how a matcher finds them: made once, and of known sizes."""
    return tables.written(corpus.inputs(spark, d), "inputs"), tables.written(_detail(spark, d), "detail")


def _postings(detail: DataFrame, index: str, cap: int) -> DataFrame:
    if index == "trigram":
        found, key = ix.trigram_phrases(ix.phrase_table(detail, "standard")), "trigramphrase"
    else:
        found, key = ix.phrase_table(detail, index), "tokenphrase"
    return ix.capped_postings(found, key, cap).select(F.col(key).alias("key"), "addr_id")


def _plain(df: DataFrame) -> DataFrame:
    """Match results without arrays, in types that both engines print alike."""
    extra = ["neighbouring_suburb_correction"] if "neighbouring_suburb_correction" in df.columns else []
    return df.select("address_id", "input_address", "address_id2", "address_matched", "suburb", "postcode", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), F.round("similarity", 6).alias("similarity"), *extra)


def _matched(how: str, top_n: int = 1):
    def query(spark: SparkSession, d: str) -> DataFrame:
        spec = mt.CATALOGUE[how]
        inputs, detail = _stored(spark, d)
        return _plain(bl.match(inputs, detail, mt.INDEX[spec.phrases], spec, top_n))

    return query


def _match_neighbours(how: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        inputs, detail = _stored(spark, d)
        return _plain(bl.match(inputs, detail, "standard", how, 1, corpus.neighbours(spark, d)))

    return query


def _texts(f, name: str):
    return lambda spark, d: corpus.read(spark, d, "documents").select("doc_id", f(F.col("text")).alias(name))


def _joined_tokens(f):
    return _texts(lambda c: F.coalesce(F.array_join(f(text.clean_input(c)), "|"), F.lit("none")), "tokens")


def _phrase_query(how: str):
    return lambda spark, d: ix.phrase_table(_detail(spark, d), how)


def _counted(table: DataFrame, key: str) -> DataFrame:
    index = ix.invert(table, key)
    return index.select(key, F.array_join(F.array_sort("addr_ids"), ",").alias("addr_ids"), "frequency")


def _trigram_table(spark, d):
    return ix.trigram_phrases(ix.phrase_table(_detail(spark, d), "standard"))


def _candidates(spark, d) -> DataFrame:
    inputs, detail = _stored(spark, d)
    own = mt.prepared(inputs, mt.CATALOGUE["standard"])
    return mt.candidates(mt.input_phrases(own, mt.CATALOGUE["standard"]), _postings(detail, "standard", 1000))


def _filtered(how: str):
    def query(spark, d):
        spec = mt.CATALOGUE[how]
        inputs, detail = _stored(spark, d)
        own = mt.prepared(inputs, spec)
        pairs = mt.candidates(mt.input_phrases(own, spec), _postings(detail, mt.INDEX[spec.phrases], spec.cap))
        return mt.compared(pairs, own, detail, spec).select("address_id1", "address_id2")

    return query


def _pairs(spark, d) -> DataFrame:
    """Every input with the address it was made from, both whole texts: (address_id, addr_id, x, y)."""
    inputs = corpus.inputs(spark, d).select("address_id", F.col("address").alias("x"))
    known = corpus.addresses(spark, d).select("addr_id", F.col("ADDRESS_LABEL").alias("y"))
    return inputs.join(known, F.col("address_id") == F.col("addr_id") + 1)


def _words(c):
    return F.split(F.lower(c), " ")


PAIRS_SQL = f"""{ADDRESSES_SQL},
{INPUTS_SQL},
pairs AS (SELECT address_id, addr_id, address AS x, ADDRESS_LABEL AS y, string_split(lower(address), ' ') AS a, string_split(lower(ADDRESS_LABEL), ' ') AS b FROM inputs JOIN addresses ON address_id = addr_id + 1)"""

#: (measure, what is made of each text before, digits) by query.
SIMILAR = {
    "sim_list_overlap": (lambda a, b: similarity.list_overlap(a, b, 0.5), _words, None),
    "sim_numeric_overlap": (similarity.numeric_overlap, _words, None),
    "sim_numeric_overlap2": (similarity.numeric_overlap2, _words, None),
    "sim_iou": (similarity.iou, _words, None),
    "sim_iou_min": (similarity.iou_min, _words, None),
    "sim_multiset_jaccard": (similarity.multiset_jaccard, _words, None),
    "sim_ngram_jaccard": (similarity.ngram_jaccard, lambda c: c, None),
    "sim_jaro": (similarity.jaro, lambda c: c, 6),
    "sim_jaro_winkler": (similarity.jaro_winkler, lambda c: c, 6),
}


def similar(name: str, pairs: DataFrame) -> DataFrame:
    """``pairs`` with the measure ``name`` of their texts x and y as value, in place of these."""
    f, prepared, digits = SIMILAR[name]
    value = f(prepared(F.col("x")), prepared(F.col("y")))
    return pairs.withColumn("value", F.round(value, digits) if digits else value).drop("x", "y")


def _cascade(spark, d) -> DataFrame:
    (inputs, detail), rest = _stored(spark, d), []
    for how, threshold in (("standard", 0.9), ("trigram", 0.5)):
        spec = mt.CATALOGUE[how]
        rest.append((lambda df, spec=spec: bl.match(df, detail, mt.INDEX[spec.phrases], spec), threshold))
    return _plain(rs.cascade(inputs, rest, lambda df: tables.written(df, "cascade")))


def _cascade_sql() -> str:
    one, two = SQL["match_standard"], SQL["match_trigram"]
    return f"WITH one AS ({one}), two AS ({two}) SELECT * FROM one WHERE coalesce(similarity >= 0.9, false) UNION ALL SELECT * FROM two WHERE address_id NOT IN (SELECT address_id FROM one WHERE coalesce(similarity >= 0.9, false))"


def _benchmark(spark, d) -> DataFrame:
    inputs, detail = _stored(spark, d)
    found = bl.match(inputs, detail, "standard", "standard")
    expected = detail.select((F.col("addr_id") + 1).alias("address_id"), F.col("addr").alias("expected_address"))
    return rs.accuracy(rs.judged(found, expected))


def _reverse(spark, d) -> DataFrame:
    points = corpus.addresses(spark, d).select("addr_id", F.col("LATITUDE").alias("latitude"), F.col("LONGITUDE").alias("longitude"))
    s = corpus.read(spark, d, "supplier")
    queries = s.select(F.col("s_suppkey").alias("query_id"), F.expr("cast(s_suppkey * 7919 % 17000 as double) / 100 - 85").alias("latitude"), F.expr("cast(s_suppkey * 104729 % 35000 as double) / 100 - 175").alias("longitude"))
    return nr.nearest(queries, points).select("query_id", "addr_id", F.round("distance", 6).alias("distance"))


def _mapped(spark, d, states=None) -> DataFrame:
    mapping = {"addr_id": "s_suppkey", "address_label": "concat(s_name, ' ', n_name)", "locality_name": "n_name", "state": "r_name", "latitude": "s_acctbal / 100"}
    s, n, r = (corpus.read(spark, d, t) for t in ("supplier", "nation", "region"))
    df = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    if states:
        df = df.where(F.col("r_name").isin(states))
    return tables.map_columns(df, mapping).select("addr_id", "ADDRESS_LABEL", "LOCALITY_NAME", "STATE", F.round(F.col("LATITUDE").cast("double"), 3).alias("LATITUDE"))


def _steps(spark, d) -> DataFrame:
    p = Pipeline(
        [
            Step("cleaned", lambda addresses: addresses.select("addr_id", text.clean_reference(F.col("ADDRESS_LABEL")).alias("addr")), {"addresses": "addresses"}),
            Step("sized", "SELECT addr_id, length(addr) AS n_chars, STATE FROM {cleaned} JOIN {addresses} USING (addr_id)", {"cleaned": "cleaned", "addresses": "addresses"}),
            Step("totals", "SELECT STATE AS state, count(*) AS n, sum(n_chars) AS n_chars FROM {sized} GROUP BY STATE", {"sized": "sized"}),
        ]
    )
    return p.run(spark, {"addresses": corpus.addresses(spark, d)})


QUERIES = {
    "clean_input": _texts(text.clean_input, "clean"),
    "clean_input_unicode": _texts(text.clean_input_unicode, "clean"),
    "clean_reference": _texts(text.clean_reference, "clean"),
    "split_tokens": lambda s, d: corpus.read(s, d, "documents").select("doc_id", F.posexplode(text.split_tokens(text.clean_input(F.col("text")))).alias("pos", "token")),
    "phrase_tokens": _texts(lambda c: F.array_join(text.phrase_tokens(text.clean_reference(c)), "|"), "tokens"),
    "numeric_tokens_input": _joined_tokens(text.numeric_tokens_input),
    "numeric_tokens_reference": _joined_tokens(text.numeric_tokens_reference),
    "numeric_tokens_legacy": _joined_tokens(text.numeric_tokens_legacy),
    "alpha_tokens": _joined_tokens(text.alpha_tokens),
    "addresses_with_detail": lambda s, d: _flat(_detail(s, d)),
    "addresses_normalised": lambda s, d: _flat(ix.addresses_with_detail(corpus.addresses(s, d), normalise=True)),
    "bigram_phrases": _phrase_query("bigram"),
    "standard_phrases": _phrase_query("standard"),
    "skip_phrases": _phrase_query("skipphrase"),
    "soundex_phrases": _phrase_query("soundex"),
    "trigram_phrases": _trigram_table,
    "trigram_phrases_input": lambda s, d: mt.input_phrases(mt.prepared(corpus.inputs(s, d), mt.CATALOGUE["trigram"]), mt.CATALOGUE["trigram"]),
    "md5_phrase_keys": lambda s, d: ix.phrase_table(_detail(s, d), "standard").select("addr_id", phrases.md5_prefix(F.col("tokenphrase")).alias("k5"), phrases.integer_key(F.col("tokenphrase")).alias("ki")),
    "phrase_inverted_index": lambda s, d: _counted(ix.phrase_table(_detail(s, d), "standard"), "tokenphrase"),
    "skip_inverted_index": lambda s, d: _counted(ix.phrase_table(_detail(s, d), "skipphrase"), "tokenphrase"),
    "trigram_inverted_index": lambda s, d: _counted(_trigram_table(s, d), "trigramphrase"),
    "merged_postings": lambda s, d: ix.merge_postings(ix.invert(ix.phrase_table(_detail(s, d), "standard")).select(F.substring("tokenphrase", 1, 4).alias("k"), "addr_ids", "frequency"), "k").select("k", F.array_join(F.array_sort("addr_ids"), ",").alias("addr_ids"), "frequency"),
    "frequency_capped_lookup": lambda s, d: _postings(_detail(s, d), "standard", 50),
    "candidate_generation": _candidates,
    "numeric_overlap_filter": _filtered("standard"),
    "all_numerics_filter": _filtered("bigram_contained"),
    **{name: lambda s, d, name=name: similar(name, _pairs(s, d)) for name in SIMILAR},
    "soundex_codes": lambda s, d: corpus.read(s, d, "documents").select("doc_id", F.array_join(F.transform(text.split_tokens(text.clean_input(F.col("text"))), F.soundex), " ").alias("codes")),
    "match_standard": _matched("standard"),
    "match_standard_topn": _matched("standard", 3),
    "match_skipphrase": _matched("skipphrase"),
    "match_trigram": _matched("trigram"),
    "match_trigram_contained": _matched("trigram_contained"),
    "match_trigram_contained_rare": _matched("trigram_contained_rare"),
    "match_soundex": _matched("soundex"),
    "match_bigram": _matched("bigram"),
    "match_bigram_contained": _matched("bigram_contained"),
    "match_bigram_union": _matched("bigram_union"),
    "match_bigram_multiset": _matched("bigram_multiset"),
    "match_numeric_skip_multiset": _matched("numeric_skip_multiset"),
    "match_winkler": _matched("winkler"),
    "match_winkler_matched_only": _matched("winkler_matched_only"),
    "match_neighbours": _match_neighbours("standard"),
    "match_winkler_neighbours": _match_neighbours("winkler"),
    "match_cascade": _cascade,
    "unmatched_split": lambda s, d: rs.split_matched(_matched("standard")(s, d), 0.5)[1],
    "single_response": lambda s, d: rs.one_each(_matched("standard", 3)(s, d)),
    "reverse_geocode": _reverse,
    "benchmark_accuracy": _benchmark,
    "schema_mapped_load": _mapped,
    "state_filtered_load": lambda s, d: _mapped(s, d, ["ASIA", "EUROPE"]),
    "pipeline_steps": _steps,
}


def _doc_sql(x: str, name: str) -> str:
    return f"SELECT doc_id, {x} AS {name} FROM documents"


def _token_sql(f) -> str:
    return _doc_sql(f"coalesce(array_to_string({f(_clean_input('text'))}, '|'), 'none')", "tokens")


def _pair_sql(value: str) -> str:
    return f"WITH {PAIRS_SQL} SELECT address_id, addr_id, {value} AS value FROM pairs"


_KEEP2 = _list_overlap("a", "b", 0.2)
_KEEP5 = _list_overlap("a", "b", 0.5)
_CONTAINED = "len(a) BETWEEN 1 AND 3 AND len(list_filter(a, lambda t: NOT list_contains(b, t))) = 0"
_SCORE = f"({_iou_min('aa', 'bb')}) * ({_iou('a', 'b')})"
_LEGACY_NUMERICS = lambda x: f"nullif({_numerics_reference(x)}, [])"
_NG = _ngram("address", "address_matched")


def _legacy(index, score, cap=1000, keep=None, **how):
    return _match_sql(index, "", _clean_unicode, _LEGACY_NUMERICS, cap, keep or _KEEP5, score, how.pop("prefilter", None), **how)


def _candidate_sql(index, clean, numerics, cap, keep=None):
    own = {"standard": _standard, "bigram": _bigrams}[index]
    head = f"""WITH {PHRASES_SQL[index]},
{INPUTS_SQL},
own AS (SELECT address_id AS address_id1, address, {numerics('address')} AS a FROM (SELECT address_id, {clean('address')} AS address FROM inputs)),
own_tokens AS (SELECT address_id1, string_split(address, ' ') AS t FROM own),
own_keys AS (SELECT DISTINCT address_id1, k FROM (SELECT address_id1, unnest({own('t')}) AS k FROM own_tokens)),
candidates AS (SELECT DISTINCT address_id1, addr_id AS address_id2 FROM own_keys JOIN phrase USING (k) WHERE k IN (SELECT k FROM phrase GROUP BY k HAVING count(*) < {cap}))
"""
    if keep is None:
        return head + "SELECT * FROM candidates"
    return head + f"SELECT address_id1, address_id2 FROM (SELECT c.*, o.a, d.numeric_tokens AS b FROM candidates c JOIN own o USING (address_id1) JOIN detail d ON d.addr_id = c.address_id2) WHERE {keep}"


_SUPPLIER = """SELECT CAST(s_suppkey AS INT) AS addr_id, s_name || ' ' || n_name AS ADDRESS_LABEL, n_name AS LOCALITY_NAME, r_name AS STATE, round(CAST(CAST(s_acctbal / 100 AS FLOAT) AS DOUBLE), 3) AS LATITUDE
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

_FLAT_SQL = "SELECT addr_id, addr, array_to_string(numeric_tokens, '|') AS numeric_tokens, ADDRESS_LABEL, suburb, POSTCODE, CAST(LATITUDE AS DOUBLE) AS LATITUDE, CAST(LONGITUDE AS DOUBLE) AS LONGITUDE, STATE FROM detail"

SQL = {
    "clean_input": _doc_sql(_clean_input("text"), "clean"),
    "clean_input_unicode": _doc_sql(_clean_unicode("text"), "clean"),
    "clean_reference": _doc_sql(_clean_reference("text"), "clean"),
    "split_tokens": f"SELECT doc_id, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT doc_id, string_split({_clean_input('text')}, ' ') AS t FROM documents)",
    "phrase_tokens": _doc_sql(f"array_to_string({_phrase_tokens(_clean_reference('text'))}, '|')", "tokens"),
    "numeric_tokens_input": _token_sql(_numerics_input),
    "numeric_tokens_reference": _token_sql(_numerics_reference),
    "numeric_tokens_legacy": _token_sql(_LEGACY_NUMERICS),
    "alpha_tokens": _token_sql(_alpha),
    "addresses_with_detail": f"WITH {DETAIL_SQL} {_FLAT_SQL}",
    "addresses_normalised": f"WITH {_detail_sql(_clean_input)} {_FLAT_SQL}",
    "bigram_phrases": f"WITH {PHRASES_SQL['bigram']} SELECT addr_id, k AS tokenphrase FROM phrase",
    "standard_phrases": f"WITH {PHRASES_SQL['standard']} SELECT addr_id, k AS tokenphrase FROM phrase",
    "skip_phrases": f"WITH {PHRASES_SQL['skipphrase']} SELECT addr_id, k AS tokenphrase FROM phrase",
    "soundex_codes": _doc_sql(f"array_to_string(list_transform(string_split({_clean_input('text')}, ' '), lambda w: {_soundex('w')}), ' ')", "codes"),
    "soundex_phrases": f"WITH {PHRASES_SQL['soundex']} SELECT addr_id, k AS tokenphrase FROM phrase",
    "trigram_phrases": f"WITH {PHRASES_SQL['trigram']} SELECT addr_id, k AS trigramphrase FROM phrase",
    "trigram_phrases_input": f"""WITH {corpus.PARTS_SQL}, {INPUTS_SQL}, t1 AS (SELECT address_id AS address_id1, string_split({_clean_unicode('address')}, ' ') AS t FROM inputs)
SELECT DISTINCT address_id1, key FROM (SELECT address_id1, unnest(flatten(list_transform(range(1, len(t)), lambda i: {_crossed(_input_grams('t[i]'), _input_grams('t[i + 1]'))}))) AS key FROM t1)""",
    "md5_phrase_keys": f"WITH {PHRASES_SQL['standard']} SELECT addr_id, md5(k)[1:5] AS k5, CAST('0x' || md5(k)[1:7] AS INTEGER) AS ki FROM phrase",
    "phrase_inverted_index": f"WITH {PHRASES_SQL['standard']} SELECT k AS tokenphrase, array_to_string(list_sort(array_agg(addr_id)), ',') AS addr_ids, count(*) AS frequency FROM phrase GROUP BY k",
    "skip_inverted_index": f"WITH {PHRASES_SQL['skipphrase']} SELECT k AS tokenphrase, array_to_string(list_sort(array_agg(addr_id)), ',') AS addr_ids, count(*) AS frequency FROM phrase GROUP BY k",
    "trigram_inverted_index": f"WITH {PHRASES_SQL['trigram']} SELECT k AS trigramphrase, array_to_string(list_sort(array_agg(addr_id)), ',') AS addr_ids, count(*) AS frequency FROM phrase GROUP BY k",
    "merged_postings": f"WITH {PHRASES_SQL['standard']} SELECT substr(k, 1, 4) AS k, array_to_string(list_sort(array_agg(addr_id)), ',') AS addr_ids, count(*) AS frequency FROM phrase GROUP BY substr(k, 1, 4)",
    "frequency_capped_lookup": f"WITH {PHRASES_SQL['standard']} SELECT k AS key, addr_id FROM phrase WHERE k IN (SELECT k FROM phrase GROUP BY k HAVING count(*) < 50)",
    "candidate_generation": _candidate_sql("standard", _clean_input, _numerics_input, 1000),
    "numeric_overlap_filter": _candidate_sql("standard", _clean_input, _numerics_input, 1000, _KEEP2),
    "all_numerics_filter": _candidate_sql("bigram", _clean_unicode, _LEGACY_NUMERICS, 1000, _CONTAINED),
    "sim_list_overlap": _pair_sql(_list_overlap("a", "b", 0.5)),
    "sim_numeric_overlap": _pair_sql(_overlap("a", "b")),
    "sim_numeric_overlap2": _pair_sql(_iou("a", "b")),
    "sim_iou": _pair_sql(_iou("a", "b")),
    "sim_iou_min": _pair_sql(_iou_min("a", "b")),
    "sim_multiset_jaccard": _pair_sql(_multiset("a", "b")),
    "sim_ngram_jaccard": _pair_sql(_ngram("x", "y")),
    "sim_jaro": _pair_sql("round(jaro_similarity(x, y), 6)"),
    "sim_jaro_winkler": _pair_sql("round(jaro_winkler_similarity(x, y), 6)"),
    "match_standard": _match_sql("standard", "", _clean_input, _numerics_input, 1000, _KEEP2, _SCORE, _SCORE),
    "match_standard_topn": _match_sql("standard", "", _clean_input, _numerics_input, 1000, _KEEP2, _SCORE, _SCORE, 3),
    "match_neighbours": _match_sql("standard", "", _clean_input, _numerics_input, 1000, _KEEP2, _SCORE, _SCORE, neighbours=True),
    "match_skipphrase": _legacy("skipphrase", f"jaro_similarity(address, address_matched) * ({_overlap('a', 'b')})"),
    "match_trigram": _legacy("trigram", f"({_NG}) * ({_overlap('a', 'b')})", 10_000),
    "match_trigram_contained": _legacy("trigram", "jaro_similarity(address, address_matched)", 10_000, _CONTAINED),
    "match_trigram_contained_rare": _legacy("trigram", "jaro_similarity(address, address_matched)", 1000, _CONTAINED),
    "match_soundex": _legacy("soundex", f"({_NG}) * ({_multiset('a', 'b')})", 20_000),
    "match_winkler_neighbours": _legacy("standard", f"({_NG}) * ({_multiset('a', 'b')})", prefilter="jaro_winkler_similarity(address, address_matched)", neighbours=True),
    "match_bigram": _legacy("bigram", f"({_NG}) * ({_overlap('a', 'b')})"),
    "match_bigram_contained": _legacy("bigram", "jaro_similarity(address, address_matched)", keep=_CONTAINED),
    "match_bigram_union": _legacy("bigram", f"({_NG}) * ({_iou('a', 'b')})"),
    "match_bigram_multiset": _legacy("bigram", f"({_NG}) * ({_multiset('a', 'b')})"),
    "match_numeric_skip_multiset": _legacy("standard", f"({_NG}) * ({_multiset('a', 'b')})"),
    "match_winkler": _legacy("standard", f"({_NG}) * ({_multiset('a', 'b')})", prefilter="jaro_winkler_similarity(address, address_matched)"),
    "match_winkler_matched_only": _legacy("standard", f"({_NG}) * ({_multiset('a', 'b')})", prefilter="jaro_winkler_similarity(address, address_matched)", keep_unmatched=False),
    "reverse_geocode": f"""WITH {ADDRESSES_SQL}, q AS (SELECT s_suppkey AS query_id, CAST(s_suppkey * 7919 % 17000 AS DOUBLE) / 100 - 85 AS y, CAST(s_suppkey * 104729 % 35000 AS DOUBLE) / 100 - 175 AS x FROM supplier),
d AS (SELECT query_id, addr_id, sqrt((x - LONGITUDE::DOUBLE) ** 2 + (y - LATITUDE::DOUBLE) ** 2) AS dist FROM q, addresses)
SELECT query_id, addr_id, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, addr_id) AS r FROM d) WHERE r = 1""",
    "schema_mapped_load": _SUPPLIER,
    "state_filtered_load": _SUPPLIER + " WHERE r_name IN ('ASIA', 'EUROPE')",
    "pipeline_steps": f"WITH {ADDRESSES_SQL} SELECT STATE AS state, count(*) AS n, CAST(sum(length({_clean_reference('ADDRESS_LABEL')})) AS BIGINT) AS n_chars FROM addresses GROUP BY STATE",
}
SQL["match_cascade"] = _cascade_sql()
SQL["unmatched_split"] = f"SELECT * FROM ({SQL['match_standard']}) WHERE NOT coalesce(similarity >= 0.5, false)"
SQL["single_response"] = SQL["match_standard"]
SQL["benchmark_accuracy"] = f"""WITH m AS ({SQL['match_standard']}), {ADDRESSES_SQL}, e AS (SELECT addr_id + 1 AS address_id, {_clean_reference('ADDRESS_LABEL')} AS expected FROM addresses),
j AS (SELECT coalesce(lower(trim(regexp_replace(address_matched, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(expected, '\\s+', ' ', 'g'))), false) AS ok FROM e LEFT JOIN m USING (address_id))
SELECT count(*) AS total, CAST(sum(ok::INT) AS BIGINT) AS matched, count(*) - CAST(sum(ok::INT) AS BIGINT) AS unmatched, sum(ok::INT)::DOUBLE / count(*) AS match_rate FROM j"""


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
