"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galena.llm import bpe_tree, class_lm, jaccard_join, license_scan, merkle_manifest, pairwise_quality, phrase_automata, prefix_trie, quality_rules, source_mix, suffix_dedup, template_leaks, warc_zip
from galena.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(read(spark, sf_dir, "documents"), keep="none")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.sampled(read(spark, sf_dir, "documents"))


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zip.verified(warc_zip.round_trip(read(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "set_id")


def op8_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.phrase_digests(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.proof_digests(read(spark, sf_dir, "documents"))


def op12_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # vocabulary files of the environment, which only this query needs

    return bpe_tree.token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(read(spark, sf_dir, "conversations"))


def _template_leaks_sql() -> str:
    """All windows of all documents as templates, joined to the windows of the benchmark."""
    marks = "'" + template_leaks.MARKS.replace("'", "''") + "'"
    units = ", ".join(f"'{u}'" for u in template_leaks.UNITS)

    def inner(x: str) -> str:
        return f"trim({x}, {marks})"

    def bare(x: str) -> str:
        return f"CASE WHEN lower({inner(x)}) = '' THEN {x} ELSE lower({inner(x)}) END"

    def number(x: str) -> str:
        return f"regexp_matches({inner(x)}, '{template_leaks.NUMBER_RE}')"

    stop = template_leaks.STOP_RE.replace("'", "''")
    name = template_leaks.NAME_RE.replace("'", "''")
    shape = f"""list_transform(span, lambda x, i: CASE WHEN {number('x')} THEN '<number>' WHEN {bare('x')} IN ({units}) AND i > 1 AND coalesce({number('span[i - 1]')}, FALSE) THEN '<unit>'
        WHEN i > 1 AND regexp_matches({inner('x')}, '{name}') AND NOT coalesce(regexp_matches(span[i - 1], '{stop}'), TRUE) THEN '<name>' ELSE {bare('x')} END)"""
    slot = "('<number>', '<unit>', '<name>')"
    words = "regexp_split_to_array(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')"
    return f"""
        WITH iw AS (SELECT item_id, words, least(len(words), {template_leaks.WINDOW}) AS width, len(words) - least(len(words), {template_leaks.WINDOW}) + 1 AS n_windows FROM (SELECT item_id, {words} AS words FROM benchmark) WHERE words[1] <> ''),
        ispan AS (SELECT item_id, n_windows, width, win, words[win:win + width - 1] AS span FROM (SELECT *, unnest(range(1, n_windows + 1)) AS win FROM iw)),
        ishape AS (SELECT * FROM (SELECT *, {shape} AS shape FROM ispan) WHERE len(list_filter(shape, lambda x: x NOT IN {slot} AND x <> '')) > 0),
        dw AS (SELECT doc_id, {words} AS words FROM documents),
        dspan AS (SELECT doc_id, width, p, words[p:p + width - 1] AS span FROM (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS p FROM dw, (SELECT DISTINCT width FROM iw))),
        dshape AS (SELECT doc_id, p, span, {shape} AS shape FROM dspan),
        hit AS (SELECT d.doc_id, i.item_id, i.win, i.n_windows, d.p - i.win AS shift, i.span AS a, d.span AS b, i.shape FROM dshape d JOIN ishape i ON d.shape = i.shape),
        pair AS (SELECT doc_id, item_id, shift, {bare('a[k]')} AS a, {bare('b[k]')} AS b FROM (SELECT *, unnest(range(1, len(shape) + 1)) AS k FROM hit) WHERE shape[k] IN {slot}),
        pc AS (SELECT doc_id, item_id, shift, count(DISTINCT (a, b)) AS np, count(DISTINCT a) AS na, bool_or(a <> b) AS changed FROM pair GROUP BY ALL),
        place AS (SELECT h.doc_id, h.item_id, h.win, h.n_windows, coalesce(pc.changed, FALSE) AS changed FROM hit h LEFT JOIN pc ON h.doc_id IS NOT DISTINCT FROM pc.doc_id AND h.item_id = pc.item_id AND h.shift = pc.shift WHERE coalesce(np, 0) = coalesce(na, 0)),
        leak AS (SELECT doc_id, item_id, bool_and(changed) AS changed FROM place GROUP BY doc_id, item_id HAVING count(DISTINCT win) >= {template_leaks.MIN_SHARE} * any_value(n_windows)),
        per AS (SELECT doc_id, count(*) AS n_items, array_to_string(list_sort(list(item_id)), ',') AS items, count(*) FILTER (WHERE changed) AS n_changed FROM leak GROUP BY doc_id)
        SELECT d.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items, coalesce(n_changed, 0) AS n_changed FROM documents d LEFT JOIN per ON d.doc_id IS NOT DISTINCT FROM per.doc_id"""


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_SUFFIX_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    win AS (SELECT rid, p, md5_number(substr(h, 2 * p + 1, {2 * suffix_dedup.LENGTH})) AS g FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - {suffix_dedup.LENGTH - 1})) AS p FROM d)),
    dup AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
    hit AS (SELECT rid, p, CASE WHEN p > lag(p) OVER (PARTITION BY rid ORDER BY p) + {suffix_dedup.LENGTH} THEN 1 ELSE 0 END AS fresh FROM win SEMI JOIN dup USING (g)),
    island AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM hit),
    span AS (SELECT rid, min(p) AS a, max(p) + {suffix_dedup.LENGTH} AS b FROM island GROUP BY rid, k),
    piece AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS prior FROM span),
    per AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS kept FROM piece JOIN d USING (rid) GROUP BY rid)
    SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN per USING (rid)"""

_PHRASES_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
    win AS (SELECT rid, doc_id, p, md5_number(array_to_string(w[p:p + {phrase_automata.LENGTH - 1}], ' ')) AS g FROM (SELECT *, unnest(range(1, len(w) - {phrase_automata.LENGTH - 2})) AS p FROM d)),
    low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
    hit AS (SELECT DISTINCT rid, p + k AS pos FROM win JOIN low USING (g), (SELECT unnest(range(0, {phrase_automata.LENGTH})) AS k) WHERE m < doc_id),
    word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
    kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS kept FROM word ANTI JOIN hit USING (rid, pos) GROUP BY rid),
    gone AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN gone USING (rid)"""

_JACCARD_SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[p:p + {jaccard_join.SHINGLE - 1}], ' ')) AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {jaccard_join.SHINGLE - 1}, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS p FROM d)),
    n AS (SELECT doc_id, count(*) AS n, md5(CAST(list_sort(list(g)) AS VARCHAR)) AS k FROM s GROUP BY doc_id),
    copies AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS set_id, count(*) OVER (PARTITION BY k) AS n_copies FROM n),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    pair AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {jaccard_join.SIMILARITY} * (x.n + y.n - c) - 1e-6),
    link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
    reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
    low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
    SELECT d.doc_id, least(d.doc_id, coalesce(m, d.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies, coalesce(set_id, d.doc_id) AS set_id
    FROM d LEFT JOIN copies ON copies.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id LEFT JOIN deg ON deg.a = d.doc_id"""




def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text: a step for each byte, and eight for its bits."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substr({text}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"


def _merkle_sql() -> str:
    """Levels of both kinds of trees, then a climb in which every leaf takes its siblings along."""

    def field(x: str, text: bool = False) -> str:
        return f"coalesce({f'strlen({x})' if text else f'length(CAST({x} AS VARCHAR))'} || ':' || {x}, '-')"

    lower = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    head = f"{field('doc_id')} || {field('source', True)} || {field('lang', True)} || {field('n_chars')}"
    k = merkle_manifest.FANOUT
    tampered = f"{_crc32('CAST(doc_id AS VARCHAR)')} % {merkle_manifest.TAMPERED} = 0"

    def tree(name: str, lowest: str) -> str:
        return f"""
        {name} AS (SELECT tree, 0 AS level, place, digest, count FROM ({lowest})
            UNION ALL SELECT tree, level + 1, place // {k}, sha256(string_agg(digest, '' ORDER BY place)), (any_value(count) + {k - 1}) // {k} FROM {name} WHERE count > 1 GROUP BY tree, level, place // {k})"""

    def climb(name: str, start: str, levels: str) -> str:
        own = f"n.tree IS NOT DISTINCT FROM c.tree AND n.level = c.level AND n.place // {k} = c.place // {k}"
        return f"""
        {name} AS (SELECT id, tree, 0 AS level, place, folded, path, FALSE AS done FROM ({start})
            UNION ALL SELECT id, any_value(c.tree), any_value(c.level) + 1, any_value(c.place) // {k}, sha256(string_agg(CASE WHEN n.place = c.place THEN folded ELSE digest END, '' ORDER BY n.place)),
                any_value(path) || coalesce(string_agg(digest, '' ORDER BY n.place) FILTER (WHERE n.place <> c.place), ''), FALSE
            FROM {name} c JOIN {levels} n ON {own} WHERE n.count > 1 GROUP BY id)"""

    return f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, source, sha256({head} || {field('text', True)}) AS leaf, CASE WHEN {tampered} THEN sha256({head} || {field(lower, True)}) END AS forged FROM documents),
        s AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, count(*) AS count FROM d GROUP BY source),
        leaf AS (SELECT id, doc_id, tree, count, leaf AS digest, coalesce(forged, leaf) AS folded, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
        {tree('low', 'SELECT tree, place, digest, count FROM leaf')},
        sub AS (SELECT tree, digest FROM low WHERE count = 1),
        {tree('high', 'SELECT -1 AS tree, tree AS place, digest, (SELECT count(*) FROM s) AS count FROM sub')},
        {climb('up', "SELECT id, tree, place, folded, '' AS path FROM leaf", 'low')},
        at_subroot AS (SELECT up.* FROM up JOIN low ON low.tree = up.tree AND low.level = up.level AND low.place = up.place WHERE low.count = 1),
        {climb('upper', 'SELECT id, -1 AS tree, tree AS place, folded, path FROM at_subroot', 'high')},
        at_root AS (SELECT upper.*, high.digest AS root FROM upper JOIN high ON high.level = upper.level AND high.place = upper.place WHERE high.count = 1)
        SELECT doc_id, leaf.digest AS leaf, sub.digest AS subroot, root, sha256(path) AS proof_sha256, at_root.folded AS folded_root, at_root.folded = root AS verified
        FROM leaf JOIN sub USING (tree) JOIN at_root USING (id)"""


def _trie_sql() -> str:
    """Every prefix of every rebuilt conversation, as a list; subtrees by the prefixes of each node."""
    f, h = prefix_trie.FAMILY, prefix_trie.HEADS
    return f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, unhex(md5(strlen(role) || ':' || role || text))) AS own FROM t GROUP BY conv_id),
        r AS (SELECT a.conv_id, {_crc32('CAST(a.conv_id AS VARCHAR)')} % {h} AS h, a.own, coalesce(b.own, []) AS base FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {f}),
        seq AS (SELECT conv_id, list_concat(base[1:h], own[h + 1:]) AS seq FROM r),
        pre AS (SELECT conv_id, len(seq) AS n, depth, seq[1:depth] AS p FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS depth FROM seq)),
        node AS (SELECT p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256 FROM pre GROUP BY p),
        child AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
        full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node.p[depth].text) ELSE 0 END AS saved FROM node LEFT JOIN child ON child.p = node.p),
        up AS (SELECT p[1:k] AS p, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_node)),
        sub AS (SELECT p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY p)
        SELECT x.conv_id, x.depth, parent.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
        FROM full_node x JOIN sub ON sub.p = x.p LEFT JOIN node parent ON parent.p = x.p[1:x.depth - 1] AND x.depth > 0"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_source_mix, op4_warc_zip, op5_license_scan, op6_class_lm, op7_jaccard_join, op8_template_leaks, op9_pairwise_quality, op10_phrase_automata, op11_merkle_manifest, op12_bpe_tree, op13_prefix_trie)}
ORACLES: dict[str, str] = {
    "op2_suffix_dedup": _SUFFIX_SQL,
    "op7_jaccard_join": _JACCARD_SQL,
    "op10_phrase_automata": _PHRASES_SQL,
    "op8_template_leaks": _template_leaks_sql(),
    "op11_merkle_manifest": _merkle_sql(),
    "op13_prefix_trie": _trie_sql(),
    "op4_warc_zip": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
        ), f AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
        SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 1000
    """,
}
