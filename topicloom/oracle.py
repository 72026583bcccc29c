"""DuckDB SQL of the engine's queries, put together from the pieces that several share."""

from __future__ import annotations

from topicloom.functions import words
from topicloom.functions.text import SEGMENT
from topicloom.operators.tfidf import BODY_CHARS, COMMON, KEPT, TITLE_WEIGHT


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def clean(c: str) -> str:
    out = f"coalesce({c}, '')"
    for pattern, by in ((r"```[\s\S]*?```", " "), (r"`[^`]*`", " "), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), (r"<[^>]*>", " "), (r"(?i)https?://\S+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


def singular(w: str) -> str:
    return f"""CASE WHEN length({w}) <= 3 OR {w} IN ({_list(words.SINGULAR_EXCEPTIONS)}) OR {w} LIKE '%ss' THEN {w}
      WHEN {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y'
      WHEN regexp_matches({w}, '(ss|ch|sh|x|z)es$') THEN left({w}, length({w}) - 2)
      WHEN {w} LIKE '%es' OR ({w} LIKE '%s' AND NOT regexp_matches({w}, '[uia]s$')) THEN left({w}, length({w}) - 1) ELSE {w} END"""


def tokens(c: str) -> str:
    raw = f"regexp_extract_all(regexp_replace(lower({clean(c)}), '[''’]', '', 'g'), '[a-z]+')"
    return f"list_filter(list_transform({raw}, lambda w: {singular('w')}), lambda w: length(w) >= 3 AND NOT list_contains([{_list(words.stop_words())}], w))"


def title_case(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda w: CASE WHEN lower(w) IN ({_list(words.ACRONYMS)}) THEN upper(w) ELSE upper(left(w, 1)) || substr(w, 2) END), ' ')"


NOTES = "SELECT CAST(doc_id AS VARCHAR) AS note_id, split_part(text, chr(10), 1) AS title, text AS body, coalesce(source, '') AS parent_id, doc_id AS note_idx, CAST(substr(source, 4) AS INTEGER) AS cluster_id FROM documents"
GENERIC = r"(length(regexp_replace(title, '^\s+|\s+$', '', 'g')) <= 2 OR regexp_matches(regexp_replace(title, '^\s+|\s+$', '', 'g'), '(?i)^(?:untitled$|new\s+note$|note\s*[0-9]*$|todo$|draft$|temp$|test$|copy\s+of\b|_+$)'))"
VECTORS = "SELECT vec_id, vec_id // 5 AS note_id, vec_id % 5 AS chunk_index, label, list_transform(embedding, lambda a: CAST(a AS DOUBLE)) AS v FROM embeddings"
FLAT = f"SELECT vec_id, note_id, chunk_index, label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM ({VECTORS})"
FOLDERS = """SELECT 'r' || r_regionkey AS folder_id, r_name AS title, '' AS parent_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer"""
COUNTS = "SELECT 'c' || o_custkey AS parent_id, count(*) AS note_count FROM orders GROUP BY 1"


def pooled(weight: str) -> str:
    return f"""WITH m AS (SELECT note_id, dim, sum(w * x) / sum(w) AS x FROM (SELECT *, {weight} AS w FROM ({FLAT})) GROUP BY 1, 2)
      SELECT note_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY note_id)), 6) + 0.0 AS x FROM m"""


def below(start: str) -> str:
    return f"""WITH RECURSIVE f AS ({FOLDERS}), d AS (SELECT folder_id FROM f WHERE folder_id IN ({start})
      UNION SELECT f.folder_id FROM f JOIN d ON f.parent_id = d.folder_id)"""


def _parts(flag: str, longest: int, c: str) -> str:
    split = f"regexp_split_to_array(coalesce({c}, ''), '{SEGMENT}')"
    return f"SELECT note_id, note_idx, cluster_id, {flag} AS in_title, {longest} AS longest, unnest({split}) AS seg, unnest(range(len({split}))) AS seg_no FROM notes"


def grams(body: str, longest: int, prefix: str = "") -> str:
    """N-grams of notes: titles up to trigrams, bodies up to a length."""
    return f"""{prefix}parts AS ({_parts("TRUE", 3, "title")} UNION ALL {_parts("FALSE", longest, body)}),
  {prefix}toks AS (SELECT * EXCLUDE (seg), {tokens("seg")} AS t FROM {prefix}parts),
  {prefix}places AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM {prefix}toks),
  {prefix}grams AS (SELECT note_id, note_idx, cluster_id, in_title, seg_no, i, n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS ngram
    FROM {prefix}places, (SELECT unnest([1, 2, 3]) AS n) WHERE n <= longest AND i + n - 1 <= len(t) AND NOT (n >= 2 AND t[i] = t[i + 1]) AND NOT (n = 3 AND t[i + 1] = t[i + 2]))"""


GRAMS = f"notes AS ({NOTES}), " + grams(f"substr(body, 1, {BODY_CHARS})", 2)
WHOLE_GRAMS = f"notes AS ({NOTES}), " + grams("body", 2)
IDF = f"""idf AS (SELECT ngram, count(DISTINCT note_id) AS df, CASE WHEN count(DISTINCT note_id) / (SELECT count(*) FROM notes) > {COMMON} THEN 0.0
    ELSE ln((SELECT count(*) FROM notes) / count(DISTINCT note_id)) + 1 END AS idf FROM grams GROUP BY 1)"""
def _tf(grams: str) -> str:
    return f"""tf AS (SELECT cluster_id, ngram, CAST(sum(CASE WHEN in_title THEN {TITLE_WEIGHT} ELSE 1 END) AS BIGINT) AS tf, count(DISTINCT note_id) AS n_docs, bool_or(in_title) AS in_title,
    min({{'a': note_idx, 'b': NOT in_title, 'c': seg_no, 'd': i, 'e': n}}) AS first FROM {grams} GROUP BY 1, 2),
  totals AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY cluster_id) AS DOUBLE) AS total, row_number() OVER (PARTITION BY cluster_id ORDER BY tf DESC, first) AS tf_rank, count(*) OVER (PARTITION BY cluster_id) AS kinds FROM tf)"""
def _scores(kept: int) -> str:
    return f"""scores AS (SELECT s.*, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, CASE WHEN kinds > {kept} THEN tf_rank END, first) AS rank FROM (
    SELECT t.cluster_id, ngram, kinds, tf_rank, first, tf / total * idf * (n_docs / size) * (CASE len(string_split(ngram, ' ')) WHEN 1 THEN CASE WHEN length(ngram) <= 4 THEN 0.5 ELSE 1.0 END WHEN 2 THEN 1.5 ELSE 2.0 END) * (CASE WHEN in_title THEN 1.5 ELSE 1.0 END) AS score
    FROM totals t JOIN idf USING (ngram) JOIN (SELECT cluster_id, count(*) AS size FROM notes GROUP BY 1) z ON z.cluster_id = t.cluster_id WHERE idf > 0 AND tf_rank <= {kept}) s)"""


TF, SCORES = _tf("grams"), _scores(KEPT)
#: The variant over whole bodies with trigrams and without the cap; document frequencies stay those of the capped n-grams.
FULL = f"WITH {GRAMS}, {IDF}, {grams('body', 3, 'full_')}, {_tf('full_grams')}, {_scores(1 << 40)}"
DEMOTED = """kept AS (SELECT * FROM scores s WHERE NOT EXISTS (SELECT 1 FROM scores o WHERE o.cluster_id = s.cluster_id AND contains(o.ngram, ' ')
    AND list_contains(string_split(o.ngram, ' '), s.ngram) AND o.score >= 0.5 * s.score))"""
TAXONOMY = """taxonomy AS (SELECT cluster_id, arg_min(category, place * 100 + ord) AS category FROM (
    SELECT cluster_id, place, unnest(string_split(ngram, ' ')) AS keyword FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rank) AS place FROM kept) WHERE place <= 3) JOIN (VALUES %s) AS k(keyword, category, ord) USING (keyword) GROUP BY 1)""" % ", ".join(
    f"('{keyword}', '{category}', {order})" for order, (category, keywords) in enumerate(words.TAXONOMY) for keyword in keywords
)
#: Greedy choice of tags, rank after rank.
GREEDY = """ranked AS (SELECT cluster_id, ngram, list_distinct(string_split(ngram, ' ')) AS w, row_number() OVER (PARTITION BY cluster_id ORDER BY rank) AS place FROM kept),
  picked AS (SELECT DISTINCT cluster_id, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS tags, CAST([] AS VARCHAR[]) AS used FROM ranked
    UNION ALL SELECT s.cluster_id, r.place, CASE WHEN len(tags) < 5 AND len(list_intersect(w, used)) <= CASE WHEN len(w) = 1 THEN 0 ELSE 1 END THEN list_append(tags, ngram) ELSE tags END,
      CASE WHEN len(tags) < 5 AND len(list_intersect(w, used)) <= CASE WHEN len(w) = 1 THEN 0 ELSE 1 END THEN list_concat(used, w) ELSE used END
    FROM picked s JOIN ranked r ON r.cluster_id = s.cluster_id AND r.place = s.place + 1)
  SELECT cluster_id, array_to_string(arg_max(tags, place), '|') AS tags FROM picked GROUP BY 1"""
#: Scored n-grams with known subjects, four for each nation.
SUBJECTS = ["travel plans", "fund", "meal prep", "bread recipe", "gym", "javascript code", "quotes", "zebra", "lemon tree", "quiet river", "stone", "blue glass"]
SUBJECT_SCORES = f"""scores AS (SELECT n_nationkey AS cluster_id, CAST(r AS INTEGER) AS rank, list_extract([{_list(SUBJECTS)}], (n_nationkey * 5 + r * 3) % {len(SUBJECTS)} + 1) AS ngram, CAST(1 AS DOUBLE) / r AS score FROM nation, range(1, 5) t(r))"""
NAMES = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rank) AS place FROM kept) WHERE place = 1),
  second AS (SELECT k.cluster_id, arg_min(k.ngram, k.rank) AS ngram, arg_min(k.score, k.rank) AS score FROM kept k JOIN best b ON b.cluster_id = k.cluster_id AND k.rank > b.rank
    WHERE k.score > 0 AND NOT list_has_any(string_split(k.ngram, ' '), string_split(b.ngram, ' ')) GROUP BY 1),
  names AS (SELECT c.cluster_id, CASE WHEN b.ngram IS NULL OR b.score <= 0 THEN CASE WHEN c.cluster_id % 2 = 0 THEN 'General' ELSE 'Miscellaneous' END
    ELSE coalesce(category, CASE WHEN s.score >= b.score * 0.6 THEN {title_case("b.ngram")} || ' & ' || {title_case("s.ngram")} ELSE {title_case("b.ngram")} END) END AS name
    FROM (SELECT DISTINCT cluster_id FROM notes) c LEFT JOIN best b USING (cluster_id) LEFT JOIN second s USING (cluster_id) LEFT JOIN taxonomy USING (cluster_id))"""


def labelled(*parts: str, whole: bool = False) -> str:
    """Scores of clusters' n-grams, by the beginnings of bodies or by whole bodies."""
    return "WITH " + ",\n  ".join((WHOLE_GRAMS if whole else GRAMS, IDF, TF, SCORES, *parts)) + "\n"
