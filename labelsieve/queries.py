"""Registered queries of the label operators, over tables derived from the given ones, and the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve import fixtures as fx
from labelsieve.functions import text as tx
from labelsieve.operators import findings as fi
from labelsieve.operators import history as hi
from labelsieve.operators import lines as ln
from labelsieve.operators.codes import parse_codes
from labelsieve.operators.rules import generic_rules
from labelsieve.operators.scan import find_phrases, scan_dictionary, with_occurrences
from labelsieve.operators.segments import segment
from labelsieve.operators.stitch import overlap_candidates, stitch_texts
from labelsieve.plans import packs
from labelsieve.plans.screen import flagged_terms, screen_labels
from labelsieve.sources import fixed
from labelsieve.sources.seeds import DICTIONARY, _rows, lexicon
from labelsieve.sources.rules import rule_rows
from labelsieve.sources.tables import load_dictionary, local_table, phrases, rule_terms
from labelsieve.streaming import live

Query = Callable[[SparkSession, str], DataFrame]


def _norm(s: SparkSession, d: str) -> DataFrame:
    return fx.labels(s, d).select("label_id", tx.normalize_text("text").alias("norm"))


def normalize(s: SparkSession, d: str) -> DataFrame:
    return _norm(s, d)


def text_functions(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return fx.labels(s, d).select(
        "label_id", tx.has_chinese(t).alias("has_chinese"), tx.cjk_count(t).cast("long").alias("cjk_count"), tx.squash_ws(t).alias("squashed"), tx.is_alcoholic(t).alias("alcoholic"),
        tx.ai_text_usable(t).alias("usable"), tx.translate_url(t)[0].alias("url"), tx.snippet(t, F.lit(20), F.lit(2))["text"].alias("snippet"), tx.snippet(t, F.lit(20), F.lit(2))["offset"].alias("snippet_offset"),
    )


def translate_links(s: SparkSession, d: str) -> DataFrame:
    """Both links of each whole label."""
    return fx.labels(s, d).select("label_id", tx.translate_url("text").alias("urls")).select("label_id", F.col("urls")[0].alias("baidu"), F.col("urls")[1].alias("google"))


def ocr_post(s: SparkSession, d: str) -> DataFrame:
    return fx.labels(s, d).select("label_id", tx.ocr_post_process("text").alias("text"))


def scan_dictionary_hits(s: SparkSession, d: str) -> DataFrame:
    """Matches per label and term."""
    hits = scan_dictionary(_norm(s, d), ["label_id"], "norm", lexicon(s).dictionary)
    return hits.groupBy("label_id", "term").agg(F.count(F.lit(1)).alias("n"))


def scan_latin(s: SparkSession, d: str) -> DataFrame:
    """ASCII whole-word matches over whole documents."""
    words = load_dictionary(local_table(s, [(k, w, "note", "", "", "", "") for k, w in enumerate(fx.LATIN)], "ord int, term string, status string, en string, py string, category string, note string"))
    hits = scan_dictionary(fx.table(s, d, "documents").select("doc_id", "text"), ["doc_id"], "text", words)
    return hits.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def find_phrases_all(s: SparkSession, d: str) -> DataFrame:
    kinds = phrases(s, "end", ["净含量", "地址", "100克"]).unionByName(phrases(s, "start", ["配料"]))
    return find_phrases(_norm(s, d), ["label_id"], "norm", kinds).select("label_id", "kind", "term", F.col("start").cast("long").alias("start"))


def rule_findings(s: SparkSession, d: str) -> DataFrame:
    """What the character rules find in texts that no dictionary term covers."""
    rows = with_occurrences(fx.rule_texts(s, d), ["label_id"], "text", rule_terms(s), {"matches": (["rule"], "all")})
    found = rows.select("label_id", "text", F.explode(generic_rules(F.col("text"), F.col("matches"), F.slice("matches", 1, 0))).alias("r"))
    return found.select("label_id", F.substring("text", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("term"), F.col("r.start").cast("long").alias("start"), "r.status", "r.category", "r.en")


def flagged(s: SparkSession, d: str) -> DataFrame:
    return flagged_terms(fx.labels(s, d), lexicon(s).dictionary).select("label_id", "term", "status", "count", F.col("severity").cast("int").alias("severity"), "level")


def segments(s: SparkSession, d: str) -> DataFrame:
    return segment(_norm(s, d), ["label_id"], "norm", lexicon(s).dictionary).select("label_id", F.col("seg_no").cast("int").alias("seg_no"), "zh", "status", "coverage")


def segment_pieces(s: SparkSession, d: str) -> DataFrame:
    return segment(_norm(s, d), ["label_id"], "norm", lexicon(s).dictionary).select("label_id", F.col("seg_no").cast("long").alias("seg_no"), "zh")


def codes(s: SparkSession, d: str) -> DataFrame:
    return parse_codes(_norm(s, d), ["label_id"], "norm", lexicon(s).codes).select("label_id", "code", "status")


def screen(s: SparkSession, d: str) -> DataFrame:
    out = screen_labels(fx.labels(s, d), lexicon(s), columns=["kind", "name", "section", "alcoholic", "quality", "verdict", "findings", "elsewhere", "positives", "codes"])
    return out.select("label_id", "kind", F.col("name.zh").alias("name"), F.col("section.found").alias("found"), "alcoholic", F.round("quality.coverage", 6).alias("coverage"), F.col("verdict.level").alias("level"), F.transform("findings", lambda f: f["term"]).alias("terms"), F.size("elsewhere").alias("elsewhere"), F.size("positives").alias("positives"), F.size("codes").alias("codes"))


def verdict_report(s: SparkSession, d: str) -> DataFrame:
    return packs.corpus_report(screen_labels(fx.labels(s, d), lexicon(s), columns=["kind", "verdict"]))


def dictionary_gaps(s: SparkSession, d: str) -> DataFrame:
    return packs.unknown_chunks(screen_labels(fx.labels(s, d), lexicon(s), columns=["segments"]))


def top_flagged(s: SparkSession, d: str) -> DataFrame:
    return packs.top_flagged(screen_labels(fx.labels(s, d), lexicon(s), columns=["findings"]))


def web_lists(s: SparkSession, d: str) -> DataFrame:
    """Labels without a list, screened again with the catalogue's list."""
    part = fx.table(s, d, "part").groupBy(fx._pick(fx.NAMES, F.col("p_partkey")).alias("product_name")).agg(F.min("p_partkey").alias("k"))
    catalogue = part.select("product_name", F.lit("catalogue").alias("site"), F.concat(fx._pick(fx.PIECES, F.col("k")), F.lit("、"), fx._pick(fx.PIECES, F.col("k") + 3)).alias("list_text"))
    again = packs.web_list_join(screen_labels(fx.labels(s, d), lexicon(s)), catalogue)
    return screen_labels(again, lexicon(s)).select("label_id", F.col("verdict.level").alias("level"), F.col("section.text").alias("list"))


def pack(s: SparkSession, d: str) -> DataFrame:
    out = packs.pack_verdict(fx.photos(s, d), lexicon(s), columns=["photos", "primary_no", "joins", "verdict", "findings"])
    return out.select("pack_id", "photos", "primary_no", "joins", F.col("verdict.level").alias("level"), F.transform("findings", lambda f: f["term"]).alias("terms"))


def overlaps(s: SparkSession, d: str) -> DataFrame:
    """Which line of a pack's photos may go on from which."""
    return overlap_candidates(fx.photos(s, d))


def stitch(s: SparkSession, d: str) -> DataFrame:
    return stitch_texts(fx.photos(s, d))


def combined(s: SparkSession, d: str) -> DataFrame:
    return packs.combined_text(fx.photos(s, d))


def reading_order(s: SparkSession, d: str) -> DataFrame:
    return ln.reading_order(fx.ocr_lines(s, d)).select("photo_id", F.col("line_id").cast("long").alias("line_id"), F.col("band").cast("long").alias("band"), F.col("place").cast("long").alias("place"))


def photo_texts(s: SparkSession, d: str) -> DataFrame:
    return ln.photo_texts(ln.kept_lines(fx.ocr_lines(s, d))).select("photo_id", "text", F.col("confidence").cast("long").alias("confidence"))


def box_order(s: SparkSession, d: str) -> DataFrame:
    return ln.box_order(fx.ocr_lines(s, d).select("photo_id", F.col("line_id").alias("box_id"), "x", "y"))


def read_score(s: SparkSession, d: str) -> DataFrame:
    return ln.read_score(fx.ocr_lines(s, d)).select("photo_id", "read_no", F.round("score", 6).alias("score"))


def sideways_angle(s: SparkSession, d: str) -> DataFrame:
    return ln.sideways_angle(fx.ocr_lines(s, d)).select("photo_id", F.col("angle").cast("long").alias("angle"), F.round("tall_share", 6).alias("tall_share"))


def text_confidence(s: SparkSession, d: str) -> DataFrame:
    return ln.text_confidence(fx.ocr_lines(s, d)).select("photo_id", F.col("confidence").cast("long").alias("confidence"))


def choose_read(s: SparkSession, d: str) -> DataFrame:
    return ln.choose_read(fx.ocr_lines(s, d)).groupBy("photo_id").agg(F.max("read_no").alias("read_no"), F.count(F.lit(1)).alias("lines"))


def read_merge(s: SparkSession, d: str) -> DataFrame:
    lines = fx.ocr_lines(s, d)
    regions = lines.groupBy("photo_id").agg(F.lit(100.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(90.0).alias("y1"), F.lit(12.0).alias("lh"))
    merged = ln.read_merge(lines.filter("read_no = 0"), lines.filter("read_no = 1"), regions)
    return merged.select("photo_id", F.col("line_id").cast("long").alias("line_id"), "read_no")


def latest_history(s: SparkSession, d: str) -> DataFrame:
    return hi.latest_history(fx.history(s, d)).select("user_id", "ts", F.col("place").cast("long").alias("place"))


def delete_history(s: SparkSession, d: str) -> DataFrame:
    h = fx.history(s, d)
    return hi.delete_history(h, h.filter("verdict_level = 'unknown'").select("user_id", "ts")).select("user_id", "ts", "verdict_level")


def history_preview(s: SparkSession, d: str) -> DataFrame:
    return hi.history_preview(fx.history(s, d))


def lookup_many(s: SparkSession, d: str) -> DataFrame:
    asked = ["zhu", "meat", "肉", "油", "halal", "  ", "lard", "ji", "x"]
    queries = fx.table(s, d, "part").select(F.col("p_partkey").alias("query_id"), fx._pick(asked, F.col("p_partkey")).alias("query"))
    return hi.lookup_many(queries, lexicon(s).dictionary).select("query_id", "term")


def ordered_findings(s: SparkSession, d: str) -> DataFrame:
    """Each label's dictionary matches as findings: one per term and status, gravest first."""
    hits = scan_dictionary(_norm(s, d), ["label_id"], "norm", lexicon(s).dictionary)
    one = fi.finding(*[F.col(c) for c in ("term", "en", "py", "status", "category", "note", "start")], "dict")
    per = hits.groupBy("label_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", one.alias("f")))), lambda x: x["f"]).alias("f"))
    judged = F.transform("f", lambda x: x.withField("severity", tx.severity(x["status"])))
    rows = fi.dedupe_findings(per, "f", "f").withColumn("f", fi.order_findings(judged))
    return rows.select(
        "label_id", fi.max_severity(F.col("f")).cast("int").alias("max_severity"), F.array_join(F.transform("f", lambda x: F.concat(x["term"], F.lit("*"), x["count"].cast("string"))), "|").alias("terms"),
        fi.top_terms(F.col("f"), lambda x: x["severity"] > 0, 3).alias("top"),
    )


def status_rollup(s: SparkSession, d: str) -> DataFrame:
    """Matches by category and status, with totals."""
    return packs.status_rollup(scan_dictionary(_norm(s, d), ["label_id"], "norm", lexicon(s).dictionary))


def marked_snippets(s: SparkSession, d: str) -> DataFrame:
    snip = tx.snippet(F.col("text"), F.lit(20), F.lit(2))
    return fx.labels(s, d).select("label_id", tx.mark_snippet(snip, F.lit("料")).alias("marked"))


def glossary_page(s: SparkSession, d: str) -> DataFrame:
    """A page of the parts in order."""
    return hi.page(fx.table(s, d, "part").select(F.col("p_partkey").alias("ord"), "p_name"), 100, 50)


def glossary(s: SparkSession, d: str) -> DataFrame:
    """The parts as a glossary: entries of one status that hold a sought text in any of their fields."""
    p = fx.table(s, d, "part")
    status = fx._pick(["ok", "haram", "review"], F.col("p_partkey"))
    entries = p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("term"), F.col("p_type").alias("en"), F.col("p_brand").alias("py"), status.alias("status"))
    return hi.glossary_filter(entries, "haram", " RED").unionByName(hi.glossary_filter(entries, "all", "brand#2")).select("ord", "term", "status")


def name_guess(s: SparkSession, d: str) -> DataFrame:
    """What a label is looked up by elsewhere: its name, its short text, the words around a product type, or its longest run."""
    rows = fx.rule_texts(s, d)
    name, alias = F.when(F.col("label_id") % 7 == 0, fx._pick(fx.NAMES, F.col("label_id"))), F.when(F.col("label_id") % 3 == 0, "骨干").when(F.col("label_id") % 3 == 1, "茶")
    return rows.select("label_id", tx.lookup_name_guess(name, F.col("text"), alias).alias("guess"))


def fallback_read(s: SparkSession, d: str) -> DataFrame:
    """The best engine's read of each photo."""
    engine = fx._pick(["basic", "phone", "server"], F.col("l_partkey") % 3)
    reads = fx.ocr_lines(s, d).join(fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), engine.alias("engine")).distinct(), "photo_id")
    texts = reads.groupBy("photo_id", "engine").agg(F.max("text").alias("text"), F.lit(50).alias("confidence"))
    return ln.fallback_read(texts).select("photo_id", "engine", "text")


def live_intake(s: SparkSession, d: str) -> DataFrame:
    return live.live_intake(live_frames(s, d)).filter("not ended").select("session_id", "frame_no")


def live_versions(s: SparkSession, d: str) -> DataFrame:
    """The buffer after every read."""
    reads = live.live_intake(live_frames(s, d)).filter("not ended")
    return reads.select("session_id", "seq", "version", "kept", F.array_join("buffer", "|").alias("texts"))


def sharp_frames(s: SparkSession, d: str) -> DataFrame:
    return live.sharp_frames(live_frames(s, d)).select("session_id", "frame_no")


def live_buffer(s: SparkSession, d: str) -> DataFrame:
    got = live.live_buffer(live.live_intake(live_frames(s, d)))
    return got.select("session_id", F.posexplode("buffer").alias("place", "text"))


def live_frames(s: SparkSession, d: str) -> DataFrame:
    return fx.frames(s, d)


def session_end(s: SparkSession, d: str) -> DataFrame:
    out = live.session_end(live.live_buffer(live.live_intake(live_frames(s, d))), lexicon(s))
    return out.select("pack_id", "text", F.col("verdict.level").alias("level"), F.transform("findings", lambda f: f["term"]).alias("terms"))


QUERIES: list[Query] = [
    normalize, text_functions, translate_links, ocr_post, scan_dictionary_hits, scan_latin, find_phrases_all, rule_findings, flagged, segments, segment_pieces, codes, screen, verdict_report, dictionary_gaps, top_flagged,
    web_lists, pack, overlaps, stitch, combined, reading_order, photo_texts, box_order, read_score, sideways_angle, text_confidence, choose_read, read_merge, latest_history, delete_history,
    history_preview, lookup_many, ordered_findings, status_rollup, marked_snippets, glossary_page, glossary, name_guess, fallback_read, live_intake, live_versions, sharp_frames, live_buffer, session_end,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


_ENTRIES = _rows(DICTIONARY, 6)
_TERMS = sorted((e[0] for e in _ENTRIES), key=lambda t: -len(t))
_ALTERNATIVES = "|".join(f"(?i:\\b{t}\\b)" if t.isascii() else t for t in _TERMS)
_VALUES = ", ".join(f"({k}, '{e[0]}', '{e[1]}', '{e[2]}', '{e[3]}')" for k, e in enumerate(_ENTRIES))
_SEVERITY = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.SEVERITY.items())
_HITS = f"""
hits AS (SELECT label_id, CASE WHEN lower(m) = 'halal' THEN 'HALAL' ELSE m END AS term FROM (SELECT label_id, unnest(regexp_extract_all(norm, '{_ALTERNATIVES}')) AS m FROM norm)),
dict AS (SELECT * FROM (VALUES {_VALUES}) AS t(ord, term, status, en, py))
"""
_CODES = {"120": "doubtful", "471": "caution", "322": "ok", "407": "ok", "412": "ok"}
_TRIM = "'[\\s　]+'"

ORACLE: dict[str, str] = {
    "normalize": f"WITH {fx.LABELS_SQL} SELECT label_id, norm FROM norm",
    "text_functions": f"""WITH {fx.LABELS_SQL} SELECT label_id, regexp_matches(text, '[一-鿿]') AS has_chinese, CAST(len(regexp_extract_all(text, '[一-鿿]')) AS BIGINT) AS cjk_count,
        regexp_replace(text, '[\\s　]+', '', 'g') AS squashed, regexp_matches(text, '(?i)酒精度|%\\s*vol|vol\\s*%|ABV|酒精含量') AS alcoholic, len(regexp_extract_all(text, '[一-鿿]')) >= 6 AS usable,
        'https://fanyi.baidu.com/#zh/en/' || url_encode(text) AS url,
        CASE WHEN length(text) > 20 THEN '…' ELSE '' END || replace(substr(text, 7, least(36, length(text)) - 6), chr(10), ' ') || CASE WHEN length(text) > 36 THEN '…' ELSE '' END AS snippet, 15 AS snippet_offset FROM labels""",
    "translate_links": f"""WITH {fx.LABELS_SQL} SELECT label_id, 'https://fanyi.baidu.com/#zh/en/' || url_encode(text) AS baidu, 'https://translate.google.com/?sl=zh-CN&tl=en&text=' || url_encode(text) || '&op=translate' AS google FROM labels""",
    "ocr_post": f"""WITH {fx.LABELS_SQL} SELECT label_id, regexp_replace(regexp_replace(t, '([一-鿿㐀-䶿豈-﫿、-〿＀-￯]) ([一-鿿㐀-䶿豈-﫿、-〿＀-￯])', '\\1\\2', 'g'), '([一-鿿㐀-䶿豈-﫿、-〿＀-￯]) ([一-鿿㐀-䶿豈-﫿、-〿＀-￯])', '\\1\\2', 'g') AS text FROM half""",
    "scan_dictionary_hits": f"WITH {fx.LABELS_SQL}, {_HITS} SELECT label_id, term, count(*) AS n FROM hits GROUP BY ALL",
    "scan_latin": f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[0-9_]', '-', 'g'), '(?i:\\b({'|'.join(fx.LATIN)})\\b)')) AS w FROM documents)
        SELECT doc_id, lower(w) AS term, count(*) AS n FROM m GROUP BY ALL""",
    "find_phrases_all": f"""WITH {fx.LABELS_SQL}, p(kind, term) AS (VALUES ('end', '净含量'), ('end', '地址'), ('end', '100克'), ('start', '配料')), spots AS (SELECT label_id, norm, unnest(range(1, length(norm) + 1)) AS i FROM norm)
        SELECT label_id, kind, term, i - 1 AS start FROM spots JOIN p ON substr(norm, i, length(term)) = term""",
    "flagged": f"""WITH {fx.LABELS_SQL}, {_HITS}, j AS (SELECT label_id, h.term, status, CASE status {_SEVERITY} END AS severity FROM hits h JOIN dict d ON h.term = d.term)
        SELECT label_id, term, status, count(*) AS "count", severity, CASE severity WHEN 6 THEN 'haram' WHEN 5 THEN 'likely' WHEN 4 THEN 'doubtful' WHEN 3 THEN 'doubtful' ELSE 'caution' END AS level FROM j WHERE severity > 0 GROUP BY ALL""",
    "segment_pieces": f"""WITH {fx.LABELS_SQL}, pieces AS (SELECT label_id, list_filter(list_transform(regexp_split_to_array(norm, '[、，,;；。.·•/／|｜()（）\\[\\]【】<>《》「」『』:：\\n\\r\\t ]'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^[\\d\\s.%,\\-+:/]+$')) AS p FROM norm)
        SELECT label_id, unnest(range(0, len(p))) AS seg_no, unnest(p) AS zh FROM pieces""",
    "codes": f"""WITH {fx.LABELS_SQL}, c AS (SELECT label_id, unnest(regexp_extract_all(norm, 'E(\\d{{3}})', 1)) AS code FROM norm UNION ALL SELECT label_id, unnest(regexp_extract_all(b, '\\d{{3}}')) FROM (SELECT label_id, unnest(regexp_extract_all(norm, '[\\s\\S]{{0,10}}\\([^()]+\\)')) AS b FROM norm) WHERE regexp_matches(b, '剂\\(') AND (contains(b, 'INS') OR NOT regexp_matches(b, '(净含量|规格|克|毫升|ml|kg).*\\(')))
        SELECT DISTINCT label_id, code, CASE code {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items())} END AS status FROM c""",
    "reading_order": f"""WITH {fx.LINES_SQL}, a AS (SELECT *, lag(y) OVER w AS py, lag(h) OVER w AS ph FROM lines WINDOW w AS (PARTITION BY photo_id ORDER BY y, line_id)),
        b AS (SELECT *, sum(CASE WHEN y - py > 0.3 * greatest(8, least(h, ph)) THEN 1 ELSE 0 END) OVER (PARTITION BY photo_id ORDER BY y, line_id ROWS UNBOUNDED PRECEDING) AS band FROM a)
        SELECT photo_id, line_id, CAST(band AS BIGINT) AS band, row_number() OVER (PARTITION BY photo_id ORDER BY band, x, y, line_id) AS place FROM b""",
    "photo_texts": f"""WITH {fx.LINES_SQL}, k AS (SELECT * FROM lines WHERE conf >= 0.5), a AS (SELECT *, lag(y) OVER w AS py, lag(h) OVER w AS ph FROM k WINDOW w AS (PARTITION BY photo_id ORDER BY y, line_id)),
        b AS (SELECT *, sum(CASE WHEN y - py > 0.3 * greatest(8, least(h, ph)) THEN 1 ELSE 0 END) OVER (PARTITION BY photo_id ORDER BY y, line_id ROWS UNBOUNDED PRECEDING) AS band FROM a)
        SELECT photo_id, string_agg(text, chr(10) ORDER BY band, x, y, line_id) AS text, CAST(round(round(100 * avg(conf), 6)) AS BIGINT) AS confidence FROM b GROUP BY photo_id""",
    "read_score": f"WITH {fx.LINES_SQL} SELECT photo_id, read_no, round(sum(conf * length(text)), 6) AS score FROM lines GROUP BY ALL",
    "sideways_angle": f"""WITH {fx.LINES_SQL}, p AS (SELECT photo_id, bool_or(regexp_matches(text, '{fixed.ANCHOR}')) AS anchor, sum(conf * length(text)) AS al, sum(CASE WHEN tall THEN conf * length(text) ELSE 0 END) AS ta, sum(CASE WHEN tall AND up THEN conf * length(text) WHEN tall THEN -conf * length(text) ELSE 0 END) AS vote FROM lines GROUP BY photo_id)
        SELECT photo_id, CAST(CASE WHEN anchor OR al = 0 OR ta < 0.12 * al THEN 0 WHEN vote >= 0 THEN 90 ELSE 270 END AS BIGINT) AS angle, round(CASE WHEN al > 0 THEN ta / al ELSE 0 END, 6) AS tall_share FROM p""",
    "text_confidence": f"WITH {fx.LINES_SQL} SELECT photo_id, CAST(round(round(100 * avg(conf), 6)) AS BIGINT) AS confidence FROM lines WHERE conf >= 0.5 GROUP BY photo_id",
    "read_merge": f"""WITH {fx.LINES_SQL}, o AS (SELECT *, NOT (bot <= 23.6 OR top >= 86.4 OR x2 <= 103.6 OR x >= 496.4) AS inside FROM lines WHERE read_no = 0),
        g AS (SELECT photo_id, sum(CASE WHEN conf >= 0.7 THEN length(text) ELSE 0 END) AS good FROM o WHERE inside GROUP BY photo_id),
        u AS (SELECT l.photo_id FROM lines l LEFT JOIN g USING (photo_id) WHERE read_no = 1 GROUP BY l.photo_id, good HAVING sum(CASE WHEN conf >= 0.7 THEN length(text) ELSE 0 END) >= coalesce(good, 0))
        SELECT photo_id, line_id, read_no FROM o WHERE NOT (inside AND photo_id IN (SELECT photo_id FROM u)) UNION ALL SELECT photo_id, line_id, read_no FROM lines WHERE read_no = 1 AND photo_id IN (SELECT photo_id FROM u)""",
    "latest_history": f"WITH {fx.HISTORY_SQL} SELECT * FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, text, verdict_level) AS place FROM history) WHERE place <= 50",
    "delete_history": f"WITH {fx.HISTORY_SQL} SELECT user_id, ts, verdict_level FROM history h WHERE NOT EXISTS (SELECT 1 FROM history u WHERE u.verdict_level = 'unknown' AND u.user_id = h.user_id AND u.ts = h.ts)",
    "history_preview": f"WITH {fx.HISTORY_SQL} SELECT user_id, ts, CASE WHEN coalesce(name, '') <> '' THEN name || ' — ' ELSE '' END || coalesce(title, verdict_level) AS heading, substr(coalesce(text, ''), 1, 120) AS preview FROM history",
    "lookup_many": f"""WITH d AS (SELECT * FROM (VALUES {_VALUES}) AS t(ord, term, status, en, py)), q AS (SELECT p_partkey AS query_id, trim(['zhu', 'meat', '肉', '油', 'halal', '  ', 'lard', 'ji', 'x'][CAST(p_partkey % 9 AS INT) + 1]) AS q FROM part)
        SELECT query_id, term FROM q JOIN d ON q <> '' AND (contains(lower(term), q) OR contains(lower(en), q) OR contains(translate(lower(py), 'āáǎàēéěèīíǐìōóǒòūúǔùüǖǘǚǜ', 'aaaaeeeeiiiioooouuuuvvvvv'), q))""",
}
_PHOTO_PIECES = f"{fx._list(fx.PIECES)}[CAST(l_partkey % {len(fx.PIECES)} AS INT) + 1]"
ORACLE["combined"] = f"""WITH parts AS (SELECT l_orderkey AS pack_id, l_linenumber % 3 + 1 AS no, string_agg({_PHOTO_PIECES}, '、' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS part FROM lineitem GROUP BY ALL),
    n AS (SELECT pack_id, row_number() OVER w AS k, CASE WHEN row_number() OVER w = 1 THEN '配料:' ELSE right(lag(part) OVER w, 6) END || part AS text FROM parts WINDOW w AS (PARTITION BY pack_id ORDER BY no))
    SELECT pack_id, string_agg(CASE WHEN k = 1 THEN text ELSE chr(10) || chr(10) || '[photo ' || k || ']' || chr(10) || text END, '' ORDER BY k) AS text FROM n GROUP BY pack_id"""

# The fixture's photos are one line each.
ORACLE["overlaps"] = f"""WITH parts AS (SELECT l_orderkey AS pack_id, l_linenumber % 3 + 1 AS no, string_agg({_PHOTO_PIECES}, '、' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS part FROM lineitem GROUP BY ALL),
    n AS (SELECT pack_id, row_number() OVER w AS k, CASE WHEN row_number() OVER w = 1 THEN '配料:' ELSE right(lag(part) OVER w, 6) END || part AS text FROM parts WINDOW w AS (PARTITION BY pack_id ORDER BY no)),
    p AS (SELECT a.pack_id, a.k AS photo_no, b.k AS next_photo_no, a.text AS line, b.text AS next FROM n a JOIN n b ON a.pack_id = b.pack_id AND a.k <> b.k),
    e AS (SELECT pack_id, photo_no, next_photo_no, next, m, right(line, m) AS tail FROM (SELECT *, unnest(generate_series(3, least(40, length(line), length(next)))) AS m FROM p))
    SELECT pack_id, CAST(photo_no AS INT) AS photo_no, 0 AS line_no, CAST(next_photo_no AS INT) AS next_photo_no, 0 AS next_line_no, CAST(arg_max(instr(next, tail) - 1 + m, m) AS INT) AS at FROM e
    WHERE len(regexp_extract_all(tail, '[一-鿿]')) >= 2 AND instr(next, tail) > 0 AND (m >= 5 OR instr(next, tail) <= 3) GROUP BY pack_id, photo_no, next_photo_no"""


_STATUS = """CASE WHEN max(severity) > 0 THEN arg_min(status, (-severity, i)) ELSE coalesce(arg_min(status, i) FILTER (status <> 'ok'), 'ok') END"""
ORACLE["segments"] = f"""WITH {fx.LABELS_SQL}, dict AS (SELECT * FROM (VALUES {_VALUES}) AS t(ord, term, status, en, py)),
    p AS (SELECT label_id, list_filter(list_transform(regexp_split_to_array(norm, '[、，,;；。.·•/／|｜()（）\\[\\]【】<>《》「」『』:：\\n\\r\\t ]'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^[\\d\\s.%,\\-+:/]+$')) AS p FROM norm),
    q AS (SELECT label_id, CAST(unnest(range(0, len(p))) AS INT) AS seg_no, unnest(p) AS zh FROM p),
    m AS (SELECT label_id, seg_no, unnest(regexp_extract_all(zh, '{_ALTERNATIVES}')) AS m, generate_subscripts(regexp_extract_all(zh, '{_ALTERNATIVES}'), 1) AS i FROM q),
    h AS (SELECT label_id, seg_no, i, term, status, CASE status {_SEVERITY} END AS severity FROM m JOIN dict ON term = CASE WHEN lower(m) = 'halal' THEN 'HALAL' ELSE m END),
    g AS (SELECT label_id, seg_no, {_STATUS} AS status, sum(len(regexp_extract_all(term, '[一-鿿]'))) AS known FROM h GROUP BY ALL)
    SELECT q.label_id, q.seg_no, zh, coalesce(g.status, 'ok') AS status, CASE WHEN len(regexp_extract_all(zh, '[一-鿿]')) > 0 THEN least(1.0, CAST(coalesce(known, 0) AS DOUBLE) / len(regexp_extract_all(zh, '[一-鿿]'))) ELSE CAST(known IS NOT NULL AS INT) END::DOUBLE AS coverage
    FROM q LEFT JOIN g ON q.label_id = g.label_id AND q.seg_no = g.seg_no"""
ORACLE["ordered_findings"] = f"""WITH {fx.LABELS_SQL}, dict AS (SELECT * FROM (VALUES {_VALUES}) AS t(ord, term, status, en, py)),
    m AS (SELECT label_id, unnest(regexp_extract_all(norm, '{_ALTERNATIVES}')) AS m, generate_subscripts(regexp_extract_all(norm, '{_ALTERNATIVES}'), 1) AS i FROM norm),
    h AS (SELECT label_id, term, en, CASE status {_SEVERITY} END AS severity, min(i) AS i, count(*) AS n FROM m JOIN dict ON term = CASE WHEN lower(m) = 'halal' THEN 'HALAL' ELSE m END GROUP BY ALL)
    SELECT label_id, CAST(max(severity) AS INT) AS max_severity, string_agg(term || '*' || n, '|' ORDER BY severity DESC, i) AS terms,
    coalesce(array_to_string(list_slice(list(term || ' (' || en || ')' ORDER BY severity DESC, i) FILTER (severity > 0), 1, 3), ', '), '') AS top FROM h GROUP BY label_id"""
_CATEGORIES = ", ".join(f"('{e[0]}', '{e[4]}')" for e in _ENTRIES)
ORACLE["status_rollup"] = f"""WITH {fx.LABELS_SQL}, {_HITS}, c AS (SELECT * FROM (VALUES {_CATEGORIES}) AS t(term, category)), j AS (SELECT h.label_id, c.category, d.status FROM hits h JOIN dict d ON h.term = d.term JOIN c ON h.term = c.term)
    SELECT category, status, count(*) AS hits, count(DISTINCT label_id) AS labels FROM j GROUP BY ROLLUP (category, status)"""
ORACLE["marked_snippets"] = f"""WITH {fx.LABELS_SQL}, s AS (SELECT label_id, '…' || replace(substr(text, 7, least(36, length(text)) - 6), chr(10), ' ') || CASE WHEN length(text) > 36 THEN '…' ELSE '' END AS t FROM labels)
    SELECT label_id, substr(t, 1, 15) || '<mark>' || substr(t, 16, 2) || '</mark>' || substr(t, 18) AS marked FROM s"""
ORACLE["glossary_page"] = "SELECT p_partkey AS ord, p_name FROM part ORDER BY p_partkey LIMIT 100 OFFSET 50"
ORACLE["fallback_read"] = f"""WITH {fx.LINES_SQL}, e AS (SELECT DISTINCT l_orderkey AS photo_id, ['basic', 'phone', 'server'][CAST(l_partkey % 3 AS INT) + 1] AS engine FROM lineitem),
    r AS (SELECT photo_id, engine, max(text) AS text FROM lines JOIN e USING (photo_id) GROUP BY ALL)
    SELECT photo_id, arg_max(engine, engine_rank) AS engine, arg_max(text, engine_rank) AS text FROM (SELECT *, CASE engine WHEN 'server' THEN 3 WHEN 'phone' THEN 2 ELSE 1 END AS engine_rank FROM r) GROUP BY photo_id"""
ORACLE["choose_read"] = f"""WITH {fx.LINES_SQL}, s AS (SELECT photo_id, sum(CASE WHEN read_no = 0 THEN conf * length(text) END) AS s0, sum(CASE WHEN read_no = 1 THEN conf * length(text) END) AS s1 FROM lines GROUP BY photo_id),
    a AS (SELECT photo_id, bool_or(regexp_matches(text, '{fixed.ANCHOR}')) AS anchor, sum(conf * length(text)) AS al, sum(CASE WHEN tall THEN conf * length(text) ELSE 0 END) AS ta FROM lines WHERE read_no = 0 GROUP BY photo_id),
    c AS (SELECT s.photo_id, CASE WHEN s0 IS NULL OR coalesce(NOT anchor AND al > 0 AND ta >= 0.12 * al AND s1 >= CASE WHEN round(ta / al, 2) >= 0.2 THEN 1.0 ELSE 1.25 END * s0, false) THEN 1 ELSE 0 END AS read_no FROM s LEFT JOIN a ON s.photo_id = a.photo_id)
    SELECT l.photo_id, l.read_no, count(*) AS lines FROM lines l JOIN c ON l.photo_id = c.photo_id AND l.read_no = c.read_no GROUP BY ALL"""
_FRAMES = f"""WITH RECURSIVE f AS (SELECT user_id AS session_id, event_id AS frame_no, CAST(floor(epoch_us(ts) / 30000000) AS BIGINT) AS frame_ms, value AS sharpness,
      '配料:' || {fx._list(fx.PIECES)}[CAST(event_id % {len(fx.PIECES)} AS INT) + 1] || '、' || {fx._list(fx.PIECES)}[CAST((event_id * 7) % {len(fx.PIECES)} AS INT) + 1] AS text FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_ms, frame_no) AS k FROM f),
    r AS (SELECT session_id, 0::BIGINT AS k, 0::BIGINT AS frame_no, -1200::BIGINT AS last, 0::DOUBLE AS best, false AS taken, '' AS text FROM (SELECT DISTINCT session_id FROM n)
      UNION ALL SELECT n.session_id, n.k, n.frame_no, CASE WHEN n.frame_ms - r.last >= 1200 AND n.sharpness >= greatest(25, 0.45 * greatest(r.best, n.sharpness)) THEN n.frame_ms ELSE r.last END,
        CASE WHEN n.frame_ms - r.last < 1200 THEN r.best ELSE greatest(r.best, n.sharpness) END, n.frame_ms - r.last >= 1200 AND n.sharpness >= greatest(25, 0.45 * greatest(r.best, n.sharpness)), n.text
      FROM r JOIN n ON n.session_id = r.session_id AND n.k = r.k + 1)"""
ORACLE["live_intake"] = f"{_FRAMES} SELECT session_id, frame_no FROM r WHERE taken"
ORACLE["live_buffer"] = f"""{_FRAMES}, t AS (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY k) AS j FROM r WHERE taken),
    b AS (SELECT session_id, 0::BIGINT AS j, []::VARCHAR[] AS held FROM (SELECT DISTINCT session_id FROM t)
      UNION ALL SELECT t.session_id, t.j, CASE WHEN length(t.text) < 6 OR list_contains(b.held, t.text) THEN b.held ELSE list_slice(list_append(b.held, t.text), -24, -1) END FROM b JOIN t ON t.session_id = b.session_id AND t.j = b.j + 1),
    z AS (SELECT session_id, arg_max(held, j) AS held FROM b GROUP BY session_id)
    SELECT session_id, CAST(unnest(range(0, len(held))) AS INT) AS place, unnest(held) AS text FROM z"""

_VERSIONS = f"""{_FRAMES}, t AS (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY k) AS j FROM r WHERE taken),
    b AS (SELECT session_id, 0::BIGINT AS j, 0::BIGINT AS version, false AS kept, []::VARCHAR[] AS held FROM (SELECT DISTINCT session_id FROM t)
      UNION ALL SELECT t.session_id, t.j, b.version + CASE WHEN list_contains(b.held, t.text) THEN 0 ELSE 1 END, NOT list_contains(b.held, t.text),
        CASE WHEN list_contains(b.held, t.text) THEN b.held ELSE list_slice(list_append(b.held, t.text), -24, -1) END FROM b JOIN t ON t.session_id = b.session_id AND t.j = b.j + 1)"""
ORACLE["live_versions"] = f"{_VERSIONS} SELECT session_id, j AS seq, version, kept, array_to_string(held, '|') AS texts FROM b WHERE j > 0"
ORACLE["sharp_frames"] = """SELECT session_id, frame_no FROM (SELECT user_id AS session_id, event_id AS frame_no, value,
    max(value) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch_us(ts) / 30000000) AS BIGINT), event_id ROWS UNBOUNDED PRECEDING) AS best FROM events) WHERE value >= greatest(25, 0.45 * best)"""

ORACLE["glossary"] = """WITH e AS (SELECT p_partkey AS ord, p_name AS term, p_type AS en, p_brand AS py, ['ok', 'haram', 'review'][CAST(p_partkey % 3 AS INT) + 1] AS status FROM part)
    SELECT ord, term, status FROM e WHERE status = 'haram' AND (contains(lower(term), 'red') OR contains(lower(en), 'red') OR contains(lower(py), 'red'))
    UNION ALL SELECT ord, term, status FROM e WHERE contains(lower(term), 'brand#2') OR contains(lower(en), 'brand#2') OR contains(lower(py), 'brand#2')"""
ORACLE["name_guess"] = f"""WITH {fx.RULE_TEXTS_SQL}, t AS (SELECT label_id, trim(regexp_replace(text, '[\\s　]+', ' ', 'g')) AS plain, CASE WHEN label_id % 7 = 0 THEN {fx._list(fx.NAMES)}[CAST(label_id % {len(fx.NAMES)} AS INT) + 1] END AS name,
      CASE label_id % 3 WHEN 0 THEN '骨干' WHEN 1 THEN '茶' END AS alias FROM texts),
    a AS (SELECT label_id, arg_min(x, k) AS around FROM (SELECT label_id, alias, unnest(regexp_extract_all(plain, '[一-鿿]{{2,14}}')) AS x, generate_subscripts(regexp_extract_all(plain, '[一-鿿]{{2,14}}'), 1) AS k FROM t) WHERE contains(x, alias) GROUP BY label_id),
    l AS (SELECT label_id, arg_max(x, length(x) * 1000 - k) AS longest FROM (SELECT label_id, unnest(regexp_extract_all(plain, '[一-鿿]{{2,12}}')) AS x, generate_subscripts(regexp_extract_all(plain, '[一-鿿]{{2,12}}'), 1) AS k FROM t) GROUP BY label_id)
    SELECT label_id, coalesce(CASE WHEN length(name) > 0 THEN name END, CASE WHEN length(plain) BETWEEN 2 AND 24 THEN plain END, CASE WHEN alias IS NOT NULL THEN coalesce(around, alias) END, longest, '') AS guess
    FROM t LEFT JOIN a USING (label_id) LEFT JOIN l USING (label_id)"""
_RULES = ", ".join(f"({k}, '{r.pattern}', {r.place}, '{r.pattern[r.place]}', {r.back}, {r.ahead}, '{r.status}', '{r.category}', '{r.en}')" for k, r in enumerate(rule_rows()))
_HAN_RUN = "[㐀-鿿豈-﫿]*"
ORACLE["rule_findings"] = f"""WITH RECURSIVE {fx.RULE_TEXTS_SQL}, rules(k, pattern, place, ch, back, ahead, status, category, en) AS (VALUES {_RULES}),
    spots AS (SELECT label_id, text, unnest(range(1, length(text) + 1)) AS i FROM texts),
    met AS (SELECT label_id, i, text, min(k) AS k FROM spots JOIN rules ON substr(text, i, 1) = ch AND i > place AND substr(text, i - place, length(pattern)) = pattern GROUP BY ALL),
    sized AS (SELECT label_id, text, i - 1 AS pos, row_number() OVER (PARTITION BY label_id ORDER BY i) AS n, status, category, en,
      i - 1 - least(back, length(regexp_extract(substr(text, 1, i - 1), '({_HAN_RUN})$', 1))) AS lo, i + least(ahead, length(regexp_extract(substr(text, i + 1), '^({_HAN_RUN})', 1))) AS hi FROM met JOIN rules USING (k)),
    f AS (SELECT label_id, 0::BIGINT AS n, 0::BIGINT AS past, false AS taken, 0::BIGINT AS lo, 0::BIGINT AS hi, '' AS status, '' AS category, '' AS en FROM texts
      UNION ALL SELECT s.label_id, s.n, CASE WHEN d THEN f.past ELSE s.hi END, NOT d, greatest(s.lo, f.past), s.hi, s.status, s.category, s.en
      FROM f JOIN sized s ON s.label_id = f.label_id AND s.n = f.n + 1,
      LATERAL (SELECT s.status = '' OR s.pos < f.past OR (s.category <> 'pork' AND regexp_matches(substr(s.text, greatest(greatest(s.lo, f.past) - 2, 0) + 1, s.hi - greatest(s.lo, f.past) + 4), '{fixed.ADDRESS}')) AS d))
    SELECT label_id, substr(text, lo + 1, hi - lo) AS term, lo AS start, status, category, en FROM f JOIN texts USING (label_id) WHERE taken"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
