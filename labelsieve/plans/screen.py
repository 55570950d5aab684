"""W1: screen a table of labels. One pass over all word tables; each label is judged where it is read, or by columns if a word table is joined."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from labelsieve.functions.text import cjk_count, has_chinese, is_alcoholic, normalize_text, severity
from labelsieve.operators import findings as fi
from labelsieve.operators import judge
from labelsieve.operators.codes import code_mentions, join_codes
from labelsieve.operators.products import nonfood_product_guess, product_guess
from labelsieve.operators.rules import apply_settings, declared_free, generic_rules, prev_match_guard
from labelsieve.operators.scan import Terms, food_terms, leftmost_longest, scan_dictionary, with_occurrences
from labelsieve.operators.section import accepts_start, detect_kind, detect_name, find_section, known_share
from labelsieve.operators.segments import coverage, judged_segments, label_pieces, label_segments, segment, segments_coverage, unreadable
from labelsieve.operators.verdict import food_verdict, nonfood_verdict
from labelsieve.sources.tables import BROADCAST_ROWS, Lexicon, Settings, stored

OPTIONS = {"ocr_confidence": "int", "product_kind": "string", "ai_read": "boolean", "web_source": "string"}


def _with_options(labels: DataFrame, settings: Settings) -> DataFrame:
    missing = {c: F.lit(settings.product_kind if c == "product_kind" else None).cast(t) for c, t in OPTIONS.items() if c not in labels.columns}
    rows = labels.withColumns(missing) if missing else labels
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.withColumn("text", text if settings.max_chars is None else F.substring(text, 1, settings.max_chars))


#: Array columns of occurrences that a screen needs: kinds, and which of them.
SOUGHT = {
    "food": (["food"], "all"), "food_hits": (["food"], "longest"), "nonfood_hits": (["nonfood"], "longest"), "product": (["product"], "first"), "product_nonfood": (["product_nonfood"], "all"),
    "headers": (["start", "start_nonfood"], "all"), "ends": (["end"], "all"), "strong": (["strong"], "first"), "weak": (["weak"], "first"), "triggers": (["rule"], "all"), "code_marks": (["code"], "all"), "parens": (["paren"], "all"),
}


def marked_labels(labels: DataFrame, lexicon: Lexicon, settings: Settings) -> DataFrame:
    """Labels with their normalised text and, by kind, the occurrences of everything that is sought, in one pass and without a shuffle."""
    base = _with_options(labels, settings).select("label_id", "text", *OPTIONS).withColumn("norm", normalize_text("text"))
    seen = with_occurrences(base, ["label_id"], "norm", lexicon.ready("all", lambda: Terms(lexicon.terms())), SOUGHT)
    header = F.filter("headers", lambda h: accepts_start(h["term"], h["before"], h["after"]))
    place = lambda all_: F.transform(all_, lambda h: F.struct(h["start"].alias("start"), h["neg_len"].alias("neg_len")))
    marked = seen.withColumn("headers", header).withColumns({
        "starts": place(F.filter("headers", lambda h: h["kind"] == "start")), "starts_all": place(F.col("headers")), "ends": F.transform("ends", lambda e: e["start"]),
        "strong": F.size("strong"), "weak": F.size("weak"), "parens": F.transform("parens", lambda p: F.struct(p["start"].alias("start"))),
    })
    return marked.drop("headers")


def _section(row: DataFrame) -> Column:
    nonfood = F.col("kind") == "nonfood"
    return find_section(F.col("norm"), F.when(nonfood, F.col("starts_all")).otherwise(F.col("starts")), F.col("ends"))


def sectioned(marked: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Kind, section and the dictionary's matches of each label."""
    words = [*lexicon.detect_strong, *lexicon.detect_weak]
    row = marked.withColumn("kind", detect_kind(F.col("norm"), F.col("text"), F.col("strong"), F.col("weak"), words, F.col("product_kind")))
    row = row.withColumn("provisional", _section(row))
    # A body of less than 4 Chinese characters is a list only if it is made of known words.
    inside = F.filter("food", lambda h: (h["start"] >= F.col("provisional.start")) & (h["start"] - h["neg_len"] <= F.col("provisional.end")) & ~h["term"].rlike("[" + "、，,;；。:：" + "]"))
    body = F.col("provisional.text")
    fragment = F.col("provisional.found") & (cjk_count(body) < 4) & (F.coalesce(known_share(body, leftmost_longest(inside)), F.lit(0.0)) < 0.8)
    whole = F.struct(F.lit(False).alias("found"), F.col("norm").alias("text"), F.lit(0).alias("start"), F.length("norm").alias("end"))
    row = row.withColumn("section", F.when(fragment, whole).otherwise(F.col("provisional"))).drop("provisional", "starts", "starts_all", "ends")
    return row.withColumn("hits", F.when(F.col("kind") == "nonfood", F.col("nonfood_hits")).otherwise(F.col("food_hits"))).drop("food_hits", "nonfood_hits")


def _roles(row: DataFrame, settings: Settings) -> DataFrame:
    """Hits with their status after guard and settings, and what they are: a positive, a declaration or a finding."""
    nonfood = F.col("kind") == "nonfood"

    def one(h: Column, i: Column) -> Column:
        status = prev_match_guard(h, F.when(i > 0, F.try_element_at("hits", F.when(i > 0, i).otherwise(F.lit(1)))))
        free = declared_free(h["before"])
        role = (
            F.when(h["status"] == "ok", "none").when(status.isNull(), "none").when(status.isin("positive", "veg"), "positive")
            .when((free != "") & (status != "note"), "free").otherwise("finding")
        )
        return F.struct(h.alias("h"), status.alias("guarded"), apply_settings(status, h["category"], nonfood, settings.seafood_strict, settings.flag_flavourings).alias("status"), free.alias("free"), role.alias("role"))

    return row.withColumn("roles", F.transform("hits", one))


def _shared_codes(codes: DataFrame):
    """The table of codes sent to all tasks, by code; None if it is too large."""
    rows = codes.select("code", "name_zh", "name_en", "status", "note").limit(BROADCAST_ROWS + 1).collect()
    return codes.sparkSession.sparkContext.broadcast({r[0]: tuple(r[1:]) for r in reversed(rows)}) if len(rows) <= BROADCAST_ROWS else None


def screener(lexicon: Lexicon, settings: Settings, columns: Sequence[str]) -> Callable[[], judge.Screener] | None:
    """What makes a screener inside a task; None if a word table is too large to be sent."""
    terms = lexicon.ready("all", lambda: Terms(lexicon.terms()))
    codes = lexicon.ready("codes", lambda: _shared_codes(lexicon.codes)) if terms.local else None
    if codes is None:
        return None
    shared, words = terms.shared, [*lexicon.detect_strong, *lexicon.detect_weak]
    return lambda: judge.Screener(shared.value, codes.value, words, settings, columns)


def result_schema(names: Sequence[str], confidence: str) -> StructType:
    """Types of some columns of a screen; confidence: the type of ocr_confidence."""
    return StructType.fromDDL(", ".join(f"{c} {judge.TYPES[c].format(confidence=confidence)}" for c in names))


def screen_labels(labels: DataFrame, lexicon: Lexicon, settings: Settings | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The whole screen: label_id, kind, name, section, product, alcoholic, quality, verdict, findings, elsewhere, positives, codes, segments, normalized, had_chinese.

    labels: label_id, text and optionally ocr_confidence, product_kind, ai_read, web_source. Null text counts as empty and
    is unknown; label_id is unique. An empty table gives an empty result. columns: those to be given besides label_id, if not all.
    """
    settings, wanted = settings or Settings(), list(columns or judge.TYPES)
    make = screener(lexicon, settings, wanted)
    if make is None:
        return screen_columns(labels, lexicon, settings).select("label_id", *wanted)
    base = _with_options(labels, settings).select("label_id", "text", *OPTIONS)
    schema = result_schema(wanted, base.schema["ocr_confidence"].dataType.simpleString())
    kinds = {f.name: f.type for f in to_arrow_schema(schema)}

    def run(batches):
        one = make()
        for part in (batch.slice(k, judge.STEP) for batch in batches for k in range(0, batch.num_rows, judge.STEP)):
            with judge.uncollected():
                found = judge.columns(one.screen(*[part.column(k).to_pylist() for k in range(1, 6)]), kinds)
            yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["label_id", *kinds])

    return base.mapInArrow(run, StructType([StructField("label_id", base.schema["label_id"].dataType), *schema.fields]))


def screen_columns(labels: DataFrame, lexicon: Lexicon, settings: Settings | None = None) -> DataFrame:
    """screen_labels() by columns, for word tables of any size."""
    settings = settings or Settings()
    row = _roles(sectioned(marked_labels(labels, lexicon, settings), lexicon), settings)
    nonfood = F.col("kind") == "nonfood"
    text, section = F.col("norm"), F.col("section")
    strict_note = F.lit("strict setting: seafood other than fish")

    def positive(x: Column) -> Column:
        h, free = x["h"], x["role"] == "free"
        return F.struct(
            F.when(free, F.concat(x["free"], h["term"])).otherwise(h["term"]).alias("term"),
            F.when(free, F.concat(F.lit("declared free of "), F.when(h["en"] != "", h["en"]).otherwise(h["term"]))).otherwise(h["en"]).alias("en"),
            F.when(free, F.lit("a claim of the label")).otherwise(h["note"]).alias("note"),
            F.when(free, h["start"] - F.length(x["free"])).otherwise(h["start"]).cast("int").alias("index"),
            F.when(free, "free").when(x["guarded"] == "positive", "halal").otherwise("veg").alias("kind"),
        )

    def dict_finding(x: Column) -> Column:
        h = x["h"]
        note = F.when((x["status"] == "school") & (x["guarded"] == "seafood"), F.concat_ws(" ", F.when(h["note"] != "", h["note"]), strict_note)).otherwise(h["note"])
        return fi.finding(h["term"], h["en"], h["py"], x["status"], h["category"], note, h["start"], "dict")

    rules = F.when(nonfood, F.filter("triggers", lambda t: F.lit(False))).otherwise(F.col("triggers"))
    row = row.withColumn("positives", F.transform(F.filter("roles", lambda x: x["role"].isin("positive", "free")), positive))
    row = row.withColumn("dict_found", F.transform(F.filter("roles", lambda x: x["role"] == "finding"), dict_finding))
    row = row.withColumn("ruled", generic_rules(text, rules, F.col("hits")))
    row = row.withColumn("rule_found", F.transform("ruled", lambda r: fi.finding(F.substring(text, r["start"] + 1, r["end"] - r["start"]), r["en"], "", r["status"], r["category"], r["note"], r["start"], "rule")))
    row = _segmented(row, lexicon)
    said = F.when(nonfood, F.slice(code_mentions(text, F.col("code_marks"), F.col("parens")), 1, 0)).otherwise(code_mentions(text, F.col("code_marks"), F.col("parens")))
    # Codes build on the same rows, which are written once rather than scanned again.
    row = stored(row.withColumn("mentions", said).drop("roles", "ruled", "triggers", "code_marks", "parens", "hits", "strong", "weak"), "labels")
    nonfood, text, section = F.col("kind") == "nonfood", F.col("norm"), F.col("section")
    coded = join_codes(row.select("label_id", F.explode("mentions").alias("m")).select("label_id", "m.*"), lexicon.codes, ["label_id"])
    coded = coded.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("group", "index", "no", "code", "name_zh", "name_en", "status", "note"))).alias("codes"))
    none_coded = F.array().cast(coded.schema["codes"].dataType)
    row = row.drop("mentions").join(coded, "label_id", "left").withColumn("codes", F.coalesce("codes", none_coded))
    covered, chars = segments_coverage(F.col("segments"))
    row = row.withColumns({"coverage": covered, "cjk_chars": chars})
    code_found = F.transform(
        F.filter("codes", lambda c: c["status"] != "ok"),
        lambda c: fi.finding(F.concat(F.when(c["code"].rlike(r"^\d"), "INS ").otherwise(""), c["code"], F.when(c["name_zh"] != "", F.concat(F.lit(" "), c["name_zh"])).otherwise("")), c["name_en"], "", c["status"], "additive", c["note"], c["index"], "code"),
    )
    row = row.withColumn("code_found", code_found)
    row = fi.dedupe_findings(row.withColumn("each_found", fi.union_findings(F.col("dict_found"), F.col("rule_found"), F.col("code_found"))), "each_found", "all_found")
    row = row.withColumn("all_found", fi.judged(F.col("all_found"), text, section))
    decide, aside = fi.split_elsewhere(F.col("all_found"), section)
    chinese = has_chinese(text)
    web = F.coalesce(F.col("web_source"), F.lit(""))
    guess = F.when((~section["found"] | (web != "")) & chinese, F.when(nonfood, nonfood_product_guess(F.col("product_nonfood"))).otherwise(product_guess(F.col("product"))))
    row = row.withColumns({"findings": fi.order_findings(decide), "elsewhere": fi.order_findings(aside), "chinese": chinese, "alcoholic": is_alcoholic(text), "guess": guess})
    row = row.withColumn("noise", unreadable(F.col("kind"), F.col("ocr_confidence"), section["found"], F.col("cjk_chars"), F.col("coverage")))
    row = with_product(row, nonfood, text, section)
    noise = F.col("noise") & F.col("guess").isNull()
    marks = F.when(web != "", F.slice("positives", 1, 0)).otherwise(F.col("positives"))
    partial = F.coalesce(F.col("ai_read"), F.lit(False)) & text.rlike(r"(?i)\[?unreadable\]?")
    food = food_verdict(F.col("findings"), marks, section, F.col("alcoholic"), noise, F.col("coverage"), F.col("chinese"), F.col("guess"), F.col("web_source"), F.col("ai_read"), partial)
    verdict = F.when(nonfood, nonfood_verdict(F.col("findings"), section, noise, F.col("guess"))).otherwise(food)
    quality = F.struct("coverage", "cjk_chars", "ocr_confidence", F.col("noise").alias("unreadable"))
    return row.select("label_id", "kind", detect_name(F.col("text"), section["found"], F.col("guess.name")).alias("name"), "section", F.col("guess").alias("product"), "alcoholic", quality.alias("quality"), verdict.alias("verdict"), "findings", "elsewhere", "positives", "codes", "segments", F.col("norm").alias("normalized"), F.col("chinese").alias("had_chinese"))


def _segmented(row: DataFrame, lexicon: Lexicon) -> DataFrame:
    """row with the segments of its list, from the occurrences that the scan has found; a lexicon that is joined scans the pieces."""
    terms = lexicon.ready("food", lambda: food_terms(lexicon.dictionary))
    if not terms.local:
        found = coverage(segment(row.select("label_id", F.col("section.text").alias("scope")), ["label_id"], "scope", terms), ["label_id"]).select("label_id", "segments")
        return row.drop("food").join(found, "label_id", "left").withColumn("segments", F.coalesce("segments", F.array().cast(found.schema["segments"].dataType)))
    cut = label_pieces(terms)(F.col("norm"), F.col("section.start"), F.col("section.end"), F.transform("food", lambda h: h["start"]), F.transform("food", lambda h: -h["neg_len"]))
    pieces = row.withColumn("cut", cut).withColumn("cut", label_segments(F.col("cut"), F.col("food")))
    return pieces.withColumn("segments", judged_segments(F.col("cut"))).drop("cut", "food")


def with_product(row: DataFrame, nonfood: Column, text: Column, section: Column) -> DataFrame:
    """A forbidden or probably forbidden product name (`guess`) is a finding too; one that is known already, in the list or outside it, is counted once more."""
    product = F.col("guess")
    own = fi.finding(product["name"], product["en"], "", product["level"], "product", product["note"], product["index"], "product").withField("count", F.lit(1))
    extra = F.when(~nonfood & (product["sev"] >= 5), F.element_at(fi.judged(F.array(own), text, section), 1).withField("in_section", F.lit(False)))
    found, aside = fi.push_product(F.col("findings"), F.col("elsewhere"), F.col("extra"))
    return row.withColumn("extra", extra).withColumns({"findings": found, "elsewhere": aside}).drop("extra")


def flagged_terms(labels: DataFrame, dictionary: DataFrame, id_col: str = "label_id", text: str = "text") -> DataFrame:
    """The minimum slice: which labels list a forbidden or suspect term, which terms, how often, and the level.

    One row per label, term and status with severity above 0: id, term, status, count, index, severity, level.
    """
    hits = scan_dictionary(labels.withColumn("norm", normalize_text(text)), [id_col], "norm", dictionary)
    own = hits.withColumn("severity", severity(F.col("status"))).filter("severity > 0")
    per = own.groupBy(id_col, "term", "status", "severity").agg(F.count(F.lit(1)).alias("count"), F.min("start").alias("index"))
    level = F.element_at(F.create_map(*[F.lit(x) for k, v in {6: "haram", 5: "likely", 4: "doubtful", 3: "doubtful", 2: "caution", 1: "caution"}.items() for x in (k, v)]), F.col("severity"))
    return per.withColumn("level", level)
