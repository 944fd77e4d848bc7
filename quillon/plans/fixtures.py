"""Manuscripts, references and files derived from the test tables.

Each view is one SQL expression that Spark and DuckDB read alike, so that a query
and its SQL see the same input. Defects are planted by the key's modulus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _if(condition: str, text: str, other: str = "") -> str:
    return f"CASE WHEN {condition} THEN '{text}' ELSE '{other}' END"


_D = "doc_id"
MANUSCRIPT = " || ".join(
    [
        f"'Study ' || {_s(_D)} || {NL} || {NL}",
        f"'We report ' || {_s(f'{_D} % 400 + 100')} || '.5 kJ/mol at ' || {_s(f'{_D} % 90 + 250')} || ' K, 12.5 ± 0.4 after ' || {_s(f'{_D} % 9')} || ' runs.'",
        _if(f"{_D} % 6 = 0", " It follows [9]."),
        f"{NL} || {NL} || '1 Introduction' || {NL}",
        f"coalesce(text, '') || {NL}",
        "'Earlier results [1] agree with others [3, 2] and more [' || " + f"CASE WHEN {_D} % 5 = 0 THEN '7' WHEN {_D} % 5 = 1 THEN '4-6' ELSE '4' END || '].' || {NL}",
        f"'A value of ' || {_s(f'CASE WHEN {_D} % 3 = 0 THEN 1 ELSE {_D} % 400 + 100 END')} || '.5 kJ/mol was met.' || {NL}",
        f"'See Figure 1 and Figures 2-3 or Table 1.' || {NL} || 'Figure 1. A curve.' || {NL}",
        f"CASE WHEN {_D} % 4 = 0 THEN '' WHEN {_D} % 4 = 1 THEN 'Figure 3. Twice.' || {NL} || 'Figure 2. A map.' || {NL} ELSE 'Figure 2. A map.' || {NL} || 'Figure 3. A plot.' || {NL} END",
        f"'Table 1: Numbers.' || {NL} || " + _if(f"{_D} % 7 = 0", "Table 1: Again.") + f" || {NL}",
        f"'2 Methods' || {NL} || 'As Section 2 says, and Section ' || {_s(f'{_D} % 3 + 1')} || ' too; Table S' || {_s(f'{_D} % 4 + 1')} || '.' || {NL}",
        _if(f"{_D} % 3 = 0", "Rates of 10^6 per second but T^2^ is closed.") + f" || {NL}",
        _if(f"{_D} % 4 = 1", "The Cp curve and the dHf value of Ca2+ in Li7La3Zr2O12 at 25 oC hold.") + f" || {NL}",
        _if(f"{_D} % 5 = 2", "In this work we compute the behaviour of it — roughly.") + f" || {NL}",
        _if(f"{_D} % 7 = 3", "But Smith and co-workers have one in preparation.") + f" || {NL}",
        _if(f"{_D} % 8 = 1", "Kept at 40 degC and 310 K with 5 at% and 7 mol% and 3 wt% left.") + f" || {NL}",
        f"{NL} || " + _if(f"{_D} % 2 = 0", "Conflict of interest: the authors declare no interest at all in the outcome of it.") + f" || {NL} || {NL}",
        f"'Data availability: all is in the archive of the project and free for everyone to read.' || {NL} || {NL}",
        f"'References' || {NL}",
        f"'[1] Adams B. First long title about lattices of salts, 2001.' || {NL}",
        f"CASE WHEN {_D} % 4 = 2 THEN '[3] Cole D. Third long title about flows in pores, 2003.' || {NL} || '[2] Baker C. Second long title about melts of glass, 2002.' ELSE '[2] Baker C. Second long title about melts of glass, 2002.' || {NL} || '[3] Cole D. Third long title about flows in pores, 2003.' END || {NL}",
        f"'[4] Dunn E. Fourth long title about phases of iron, 2004.' || {NL}",
        f"CASE WHEN {_D} % 5 = 1 THEN '[5] Eads F. Fifth long title about grains of sand, 2005.' || {NL} || '[6] Ford G. Sixth long title about films of oil, 2006.' || {NL} ELSE '' END",
        f"CASE WHEN {_D} % 9 = 0 THEN '[4] Hall I. Another long title about rings of gas, 2008.' || {NL} ELSE '' END",
    ]
)
MS = f"SELECT doc_id, {MANUSCRIPT} AS text FROM documents"

# House terms out of the parts' names, and manuscripts that hold one, or nearly.
HOUSE_RULES = """
SELECT min(p_partkey) AS rule, p_name AS term, CASE WHEN min(p_partkey) % 3 = 0 THEN 'word' WHEN min(p_partkey) % 3 = 1 THEN 'stem' ELSE 'within' END AS mode,
       'house-term' AS kind, CASE WHEN min(p_partkey) % 4 = 0 THEN 'error' ELSE 'warning' END AS severity, 'the ' || p_name AS suggestion
FROM part GROUP BY p_name"""
_TERM = """CASE doc_id % 6 WHEN 0 THEN 'A ' || p_name || ', and ' || upper(p_name) || '.' WHEN 1 THEN 'Of ' || p_name || 's and x' || p_name || '.' WHEN 2 THEN replace(p_name, ' ', '  ') || ' or ' || replace(p_name, ' ', '-') || '.'
 WHEN 3 THEN p_name || '_b, ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || '!' WHEN 4 THEN replace(p_name, ' ', chr(10)) || ' (' || p_name || ')' ELSE substr(p_name, 1, length(p_name) - 1) || ' it.' END"""
HOUSE_MS = f"SELECT doc_id, 'Head' || chr(10) || {_TERM} || chr(10) || text AS text FROM (SELECT doc_id, p_name, {MANUSCRIPT} AS text FROM documents JOIN part AS q ON p_partkey = doc_id % 190) AS m"
#: Who supports a study: a statement a nation, asked for by the journals of its region.
SUPPORT = "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region AS r ON n_regionkey = r_regionkey"
_GIVEN = """CASE doc_id % 4 WHEN 0 THEN 'Thanks for support from ' || n_name || ', by award 7 of its office.' WHEN 1 THEN n_name || ' grant' || chr(10) || ' ' || chr(10) || 'An unpaid contract.'
 WHEN 2 THEN 'The ' || n_name || ' Grants office gave an award, and it says so here, at some length, for all.' ELSE 'Support  from ' || n_name || ' by award of the office' END"""
SUPPORTED = f"""SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN r_name WHEN doc_id % 7 = 5 THEN 'Elsewhere' ELSE NULL END AS journal, 'Head' || chr(10) || chr(10) || chr(10) || {_GIVEN} || chr(10) || chr(10) || text AS text
FROM (SELECT doc_id, n_name, {MANUSCRIPT} AS text FROM documents JOIN nation AS n ON n_nationkey = (doc_id % 7 + 5 * (doc_id % 5)) % 25) AS m LEFT JOIN region AS r ON r_regionkey = doc_id % 7"""

# A library out of the parts, and entries that name its works well, badly or not at all.
_P = "CAST(p_partkey AS STRING)"
LIBRARY = f"""SELECT '10.1000/p' || {_P} AS doi, 'Study of the ' || p_name || ' under ' || lower(p_type) || ' loads' || CASE WHEN p_partkey % 3 = 0 THEN ', part ' || {_P} ELSE '' END AS title,
 CASE WHEN p_partkey % 4 = 0 THEN 'Ana Kole' ELSE 'Bo Berg' END AS author FROM part"""
ENTRIES = f"""SELECT p_partkey AS doc_id, 0 AS ord, 'Berg B. ' || CASE p_partkey % 6 WHEN 0 THEN 'Study of the ' || p_name || ' under ' || lower(p_type) || ' loads, part ' || {_P} WHEN 1 THEN 'On ' || p_name || ' and ' || lower(p_type) || ' loads'
 WHEN 2 THEN 'The study of loads' WHEN 3 THEN 'Some ' || p_name || ' of 19' || {_P} WHEN 4 THEN 'Quite another thing' ELSE 'Studies: ' || upper(p_name) || ' - under loads' END || ', 2001.' AS entry FROM part"""

_NAME = "'Ana K' || substr('abcdefghij', CAST({0} % 10 AS INT) + 1, 1) || substr('lmnopqrst', CAST({0} % 9 AS INT) + 1, 1) || 'son'"
_SECOND = "'Bo T' || substr('aeiou', CAST({0} % 5 AS INT) + 1, 1) || substr('klmnrst', CAST({0} % 7 AS INT) + 1, 1) || 'berg'"
REFS = f"""
SELECT 'r' || {_s('o_orderkey')} AS key, 'On the ' || {_s('o_orderkey')} || ' orders of ' || lower(o_orderpriority) AS title,
       {_NAME.format('o_custkey')} AS author1, {_SECOND.format('o_orderkey')} AS author2,
       CAST(extract(year FROM o_orderdate) AS INT) AS year,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '10.1000/O' || {_s('o_orderkey')} END AS doi,
       {_s('o_custkey % 50')} AS volume, {_s('o_orderkey % 900')} || '-' || {_s('o_orderkey % 900 + 9')} AS first_page
FROM orders"""
REGISTRY = f"""
SELECT source, priority, '10.1000/o' || {_s('o_orderkey')} AS doi,
       CASE WHEN o_orderkey % 13 = 0 THEN 'A different work' ELSE 'On the ' || {_s('o_orderkey')} || ' orders of ' || lower(o_orderpriority) END AS title,
       CASE WHEN o_orderkey % 10 = 3 THEN replace({_NAME.format('o_custkey')}, 'Ana', 'Eva') ELSE {_NAME.format('o_custkey')} END AS author1,
       CASE WHEN o_orderkey % 12 = 5 THEN 'Cy Whitlock' ELSE {_SECOND.format('o_orderkey')} END AS author2,
       CAST(extract(year FROM o_orderdate) AS INT) + CASE WHEN o_orderkey % 17 = 0 THEN 2 WHEN o_orderkey % 17 = 1 THEN 1 ELSE 0 END AS year,
       {_s('o_custkey % 50 + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END')} AS volume,
       {_s('o_orderkey % 900 + CASE WHEN o_orderkey % 23 = 0 THEN 5 ELSE 0 END')} AS first_page
FROM orders, (SELECT 'alpha' AS source, 0 AS priority UNION ALL SELECT 'beta' AS source, 1 AS priority) AS s
WHERE o_orderkey % 7 <> 0 AND (priority = 1 OR o_orderkey % 3 <> 0)"""
PARAS = """
SELECT o_custkey AS doc_id, o_orderkey AS para_ord, repeat('word ', 40) || CAST(o_orderkey AS STRING) AS text,
       CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE '24' END AS size, CASE WHEN o_orderkey % 10 = 0 THEN '0' ELSE '120' END AS after,
       'auto:360' AS line, CASE WHEN o_orderkey % 15 = 0 THEN 'left' ELSE 'justify' END AS align, CAST(NULL AS STRING) AS style
FROM orders"""
FILES = """
SELECT p_size AS repo_id, CASE WHEN p_partkey % 3 = 0 THEN 'code/' ELSE '' END || 'run' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 5 = 0 THEN '_results.json' WHEN p_partkey % 4 = 0 THEN '.txt' ELSE '.py' END AS rel_path
FROM part"""
README_LINES = """
SELECT p_size AS repo_id, p_partkey AS ord, '`' || CASE WHEN p_partkey % 3 = 0 THEN 'code/' ELSE '' END || 'run' || CAST(p_partkey + CASE WHEN p_partkey % 7 = 0 THEN 100000 ELSE 0 END AS STRING) || '.py`' AS word
FROM part WHERE p_partkey % 2 = 0"""


_K, _YEAR = _s("o_orderkey"), _s("CAST(extract(year FROM o_orderdate) AS INT)")
_FAMILY = "'K' || substr('abcdefghij', CAST(o_orderkey % 10 AS INT) + 1, 1) || 'son'"
_OTHERS = """CASE WHEN o_orderkey % 5 = 0 THEN ', {"literal": "et al."}' WHEN o_orderkey % 5 = 1 THEN ', {"literal": "The Group"}' WHEN o_orderkey % 5 = 2 THEN ', "odd"' ELSE ', {"given": "Bo", "family": "Berg"}' END"""
CSL = f"""
SELECT 'o' || {_K} || '.json' AS path,
       {_if("o_orderkey % 3 = 0", '[null, "x", ')} || '{{"id": "r' || {_K} || '", "title": "On the ' || {_K} || ' orders", "author": [{{"given": "Ana", "family": "' || {_FAMILY} || '"}}' || {_OTHERS} || '], "issued": '
       || CASE WHEN o_orderkey % 7 = 0 THEN '{{}}' WHEN o_orderkey % 7 = 1 THEN '{{"date-parts": [["' || {_YEAR} || '", 3]]}}' WHEN o_orderkey % 7 = 2 THEN '{{"date-parts": [["n.d."]]}}' ELSE '{{"date-parts": [[' || {_YEAR} || ']]}}' END
       || ', "volume": ' || CASE WHEN o_orderkey % 4 = 0 THEN {_s("o_orderkey % 10")} ELSE '"' || {_s("o_orderkey % 10")} || '"' END || ', "page": "' || {_s("o_orderkey % 900")} || '-9"'
       || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ', "DOI": "10.1000/O' || {_K} || '"' END || '}}' || {_if("o_orderkey % 3 = 0", "]")} AS text
FROM orders"""
BIBTEX = f"""
SELECT 'o' || {_K} || '.bib' AS path,
       {_if("o_orderkey % 9 = 0", "@comment{x, title = {none}}")} || '@article{{b' || {_K} || ', Title = {{On {{Li}} and  M' || chr(92) || '"uller ' || {_K} || '}}, author = {{'
       || {_FAMILY} || ', Ana and ' || CASE WHEN o_orderkey % 5 = 0 THEN 'others' WHEN o_orderkey % 5 = 1 THEN 'Bo Berg' ELSE 'Berg, Bo' END || '}}, year = '
       || CASE WHEN o_orderkey % 7 = 0 THEN '{{in press}}' WHEN o_orderkey % 7 = 1 THEN '"' || {_YEAR} || '"' ELSE {_YEAR} END || ', volume = ' || {_s("o_orderkey % 10")} || ', pages = {{' || {_s("o_orderkey % 900")} || '--9}}'
       || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ', doi = "10.1000/O' || {_K} || '"' END || '}}' || {_if("o_orderkey % 13 = 0", "@book{open, title = {never")} AS text
FROM orders"""
ANSWERS = f"""
SELECT '10.1000/o' || {_K} AS doi,
       '{{"message": {{"title": [' || {_if("o_orderkey % 6 <> 0", '"A title"')} || '], "issued": ' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '{{"date-parts": [[' || {_YEAR} || ', 2]]}}' END
       || CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE ', "author": [{{"given": "Ana", "family": "' || {_FAMILY} || '"}}, {{"literal": "The Group"}}, {{"family": "Berg"}}, {{}}]' END
       || ', "volume": "' || {_s("o_orderkey % 10")} || '"' || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE ', "page": "e' || {_s("o_orderkey % 900")} || '-9"' END || '}}}}' AS first,
       CASE WHEN o_orderkey % 12 = 0 THEN '<html>' ELSE '{{"id": ' || CASE WHEN o_orderkey % 10 = 0 THEN 'null' ELSE '"W1"' END || ', "display_name": "A title", "publication_year": ' || {_YEAR}
       || ', "authorships": [{{"author": {{"display_name": "Ana ' || {_FAMILY} || '"}}}}, {{"author": {{}}}}], "biblio": {{"volume": ' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE '"7"' END || ', "first_page": "' || {_s("o_orderkey % 900")} || '"}}}}' END AS second
FROM orders"""
LATE = f"""SELECT '10.1000/O' || {_K} AS doi, '{{"message": {{"title": ["Late ' || {_K} || '"]}}}}' AS body FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey % 11 <> 0"""
_RAISED = '<w:rPr><w:vertAlign w:val="superscript"/></w:rPr>'
_FIELD = """'<w:r><w:instrText xml:space="preserve"> ADDIN ZOTERO_ITEM CSL_CITATION {{"citationItems": [{{"uris": ["http://z/items/{0}"], "itemData": {{"title": "T"{1}}}}}], "properties": {{"formattedCitation": "[' || {2} || ']"}}}} </w:instrText></w:r>'"""
WORD = f"""
SELECT {_K} AS doc_id, '<w:body><w:p><w:r><w:t>Salt &amp; ice</w:t></w:r><w:r>{_RAISED}<w:t>' || {_s("o_orderkey % 9 + 1")} || '</w:t></w:r><w:r><w:t> at 10</w:t></w:r><w:r>{_RAISED}<w:t>2</w:t></w:r></w:p><w:p><w:r><w:t>Flows¹² of x</w:t></w:r>'
       || {_FIELD.format("AAA1", ', "DOI": "10.1000/O' + "' || " + _K + " || '" + '"', "'1'")} || {_FIELD.format("BBB2", "", _s("CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END"))} || {_FIELD.format("AAA1", "", _s("CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END"))}
       || '</w:p></w:body>' AS xml
FROM orders"""


def sql(spark: SparkSession, sf_dir: str, query: str, *tables: str) -> DataFrame:
    """A view over tables of a folder, without leaving names in the session."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    query = query.replace("{", "{{").replace("}", "}}")  # braces of the texts; names of tables are put in braces
    for t in tables:
        query = query.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(query, **named)
