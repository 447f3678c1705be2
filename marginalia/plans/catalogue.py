"""All queries of the general engine with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.engine import NoteSearch
from marginalia.functions import formatting, language, paths, query, ranking, text
from marginalia.operators import corpus, index, lines, maintain, search, semantic, snippets
from marginalia.plans import sql as S
from marginalia.sources import files
from marginalia.sources.service import Collection
from marginalia.sources.snapshots import Store, live, load_refs, save_index, save_refs, search_saved
from marginalia.sources.tables import scratch, table
from marginalia.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]

#: The queries that the catalogue runs; each has hits in notes of several languages.
EXACT, PREFIX, FUZZY, FULL, WIDE = "reed harvest /np/nf", "harb fe /ap/nf", "glas furnase /np/af", "glas furn", "潮汐"
TERMS = ["furnace", "glass", "harbour"]
EXCLUDED = ["Projects/Ferry", "Inbox"]
RAW_QUERIES = ["/ap/nf something /np", "/etc/hosts", "plain words", "/np", "", "a  b /af", "/nf x /ap/np", "x /zz/ap"]
TERM_CASES = [("foo foobar", "foo bar foobar"), ("ab abc", "abc xab abcd"), ("x y", "p pq q"), ("", "a ab")]
URLS = ["https://example.org/a/b?c=1", "http://example.org/a", "example.org/x", "https://a.b.example:8080/", ""]
MILLIS = [0, 500, 1000, 1999, 60000, 65000, 3725004]


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    """The indexable notes of the tables."""
    return corpus.documents(table(spark, d, "indexed_documents"))


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the indexable notes, cut from their contents where they are read."""
    return corpus.split_lines(docs_of(spark, d), "note_id", "content")


def _searching(raw: str, **options) -> Query:
    return lambda spark, d: search.search(docs_of(spark, d), raw, **options)


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    rows = index.fields(docs_of(spark, d)).select(F.explode("tokens").alias("t"))
    return rows.select(F.lower("t").alias("term"))


def _saved_search(spark: SparkSession, d: str) -> DataFrame:
    """Saves the index in a fresh folder beside the checkpoints and searches the saved tables."""
    store = Store(spark, _scratch(spark), "notes")
    save_index(store, docs_of(spark, d), table(spark, d, "doc_refs").select("path", "update_time"))
    return search_saved(store, FULL).select("note_id", "score")


def _scratch(spark: SparkSession) -> str:
    """A fresh folder in the folder for intermediate tables."""
    return f"{scratch(spark)}/marginalia-{uuid.uuid4().hex}"


def _changed_index(spark: SparkSession, d: str) -> DataFrame:
    """The saved index of all notes after the whole change feed went through the stream into it."""
    home = _scratch(spark)
    engine = NoteSearch(spark, table(spark, d, "indexed_documents"), store=Store(spark, home, "notes"))
    engine.reindex()
    engine.follow(d, f"{home}/checkpoint", once=True).awaitTermination()
    terms = live(engine.store, "postings").groupBy("note_id").agg(F.count(F.lit(1)).alias("n_postings"))
    return live(engine.store, "documents").join(terms, "note_id", "left").select("note_id", "path", F.coalesce("n_postings", F.lit(0)).alias("n_postings"))


def _saved_refs(spark: SparkSession, d: str) -> DataFrame:
    """The references of both engines, saved and read back, after a change to each."""
    engine = NoteSearch(spark, table(spark, d, "indexed_documents"), store=Store(spark, _scratch(spark), "notes"))
    files = engine.current_files()
    for name in ("lexical", "semantic"):
        save_refs(engine.store, name, table(spark, d, "doc_refs").where((F.col("engine") == name) & F.col("path").isNotNull()).groupBy("path").agg(F.max("update_time").alias("update_time")))
        engine._follow_refs(name)
    assert files.columns == ["path", "update_time"]
    return load_refs(engine.store, "lexical").withColumn("engine", F.lit("lexical")).unionByName(load_refs(engine.store, "semantic").withColumn("engine", F.lit("semantic")))


def _vectors_kept(spark: SparkSession, d: str) -> DataFrame:
    """The stored vectors after a deletion, an addition of all and another deletion."""
    own = Collection(Store(spark, _scratch(spark), "notes"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), "embedding", "label")
    own.reindex(rows)
    own.delete(rows.where("label = 0").select("path"))
    own.add(rows)
    own.delete(rows.where("label = 1").select("path"))
    return own.rows().select("path", F.size("embedding").alias("numbers"))


def _stale(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a store that a newer one drops."""
    home = _scratch(spark)
    for version in (1, 2, 3):
        Store(spark, home, "notes", version).save("region", table(spark, d, "region"))
    dropped = Store(spark, home, "notes", 3).drop_stale_versions()
    return _values(spark, [(x,) for x in dropped], "version string")


def _file_sources(spark: SparkSession, d: str) -> DataFrame:
    """The nations written as files, listed and read back; the folders they lie in are no files."""
    home = _scratch(spark)
    nations = table(spark, d, "nation").select(F.concat_ws("\n", "n_name", F.col("n_regionkey").cast("string")).alias("value"), F.concat("n_nationkey", F.lit(".md")).alias("name"))
    nations.write.partitionBy("name").text(home)
    key = F.regexp_extract("path", r"name=(\d+)\.md/", 1).cast("int").alias("n_nationkey")
    listed = files.list_files(spark, home, ("txt",)).select(key, "size")
    return files.read_files(spark, home, ("txt",)).select(key, "content").join(listed, "n_nationkey")


def _flushes(spark: SparkSession, d: str) -> DataFrame:
    """What a buffer of three keys flushes of the nations' regions and names, one after another."""
    out: list[list[str]] = []
    buffer = changes.Buffer(out.append, lambda e: e.rpartition(":")[0], 3)
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():
        buffer.add(f"{r['n_regionkey']}:{r['n_nationkey']}")
    buffer.flush()
    return _values(spark, [(k, " ".join(x)) for k, x in enumerate(out)], "flush_no int, held string")


def _events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind == "signup", "create").when(kind == "purchase", "rename").when(kind == "error", "delete").otherwise("modify")
    path = F.format_string("user_%d.md", "user_id")
    return table(spark, d, "events").select(event.alias("event"), path.alias("path"), F.concat(F.lit("old_"), path).alias("old_path"), F.col("ts").alias("op_time"))


def _values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = lines_of(spark, d)
    return lines.top_lines(own, TERMS), own


def _highlight(spark: SparkSession, d: str) -> DataFrame:
    limits = snippets.LIMITS["subItem", False]

    @F.pandas_udf("struct<columns: string, marked: string>")
    def marked(texts):
        import pandas as pd

        out = [snippets.marked_columns(t, ["furnace"], limits) for t in texts]
        return pd.DataFrame({"columns": [" ".join(map(str, c)) for c in out], "marked": [snippets.mark(t, c) for t, c in zip(texts, out, strict=True)]})

    hits = lines.top_lines(lines_of(spark, d), ["furnace"])
    return hits.select("note_id", "row_no", marked("text").alias("m")).select("note_id", "row_no", "m.columns", "m.marked")


def _first_vector(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return semantic.top_k(vectors, vectors.where("vec_id = 0").first()["embedding"], 10)


def _every_hundredth_vector(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return semantic.top_k_each(vectors, vectors.where("vec_id % 100 = 0"), 10)


def _last_query(spark: SparkSession, d: str) -> DataFrame:
    return maintain.last_query(table(spark, d, "events").select("event_id", F.col("props").alias("query")), "event_id")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return changes.replay(spark, d, _scratch(spark))


def _present(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "indexed_documents").where("path is not null").select("vault", "path")
    return maintain.apply_changes(notes, maintain.net_change(table(spark, d, "change_ops")))


def _maximal(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, [(i, *c) for i, c in enumerate(TERM_CASES)], "case_id int, q string, m string")
    terms = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    return rows.select("case_id", F.array_join(query.maximal(terms(F.col("q")), terms(F.col("m"))), " ").alias("terms"))


def _counter(spark: SparkSession, d: str) -> DataFrame:
    hits = search.search(docs_of(spark, d), FULL)
    return hits.select("note_id", F.format_string("%d / %d", "rank", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).alias("shown"))


def _cursor(spark: SparkSession, d: str) -> DataFrame:
    """The places before and behind each result, held inside the list."""
    hits = search.search(docs_of(spark, d), FULL)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).cast("int")
    return hits.select("note_id", query.cursor(F.col("rank") - 1, -1, n).alias("before"), query.cursor(F.col("rank") - 1, 1, n).alias("behind"))


def _note_lines(spark: SparkSession, d: str) -> DataFrame:
    """The best lines of each vault: scored once, repeated rows dropped among the few that match."""
    hits = lines.matching_lines(table(spark, d, "note_lines").select("vault", "note_id", "row_no", "text"), TERMS).dropDuplicates(["note_id", "row_no"])
    order = Window.partitionBy("vault").orderBy(F.desc("score"), "row_no", "text", "note_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= lines.LINES).select("vault", "note_id", "row_no", "score")


def _matched_of_notes(spark: SparkSession, d: str) -> DataFrame:
    """The terms to look for in each note that has terms beginning with parts of a query."""
    asked = ["glass", "gla", "furnace", "fur"]
    own = docs_of(spark, d).select("note_id", F.array_sort(F.array_distinct(F.filter(text.terms(F.col("content")), lambda t: t.startswith("gla") | t.startswith("fur")))).alias("m")).where(F.size("m") > 0)
    return own.select("note_id", F.array_join(query.maximal(F.array(*map(F.lit, asked)), F.col("m")), " ").alias("terms"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    found = semantic.search_passages(semantic.embedded(semantic.passages(docs_of(spark, d))), " glass furnace kiln ", k=30)
    return found.select("path", "rank", "similarity", F.size("items").alias("n_items"))


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_of(spark, d)
    return snippets.snippets(docs, corpus.split_lines(docs, "note_id", "content"), TERMS, "furnace glass harbour")


def _line_snippets(spark: SparkSession, d: str) -> DataFrame:
    own = lines_of(spark, d)
    return snippets.line_snippets(lines.top_lines(own, ["furnace"]), ["furnace"], "furnace")


def queries() -> dict[str, Query]:
    notes = lambda s, d: table(s, d, "indexed_documents")
    ops = lambda s, d: table(s, d, "change_ops")
    refs = lambda s, d: table(s, d, "doc_refs")
    times = lambda s, d: notes(s, d).select("path", F.col("indexed_at").alias("update_time"))
    return {
        # sources, projections, filters
        "index_documents_scan": lambda s, d: docs_of(s, d).select("note_id", "path", "basename", "folder", "aliases", "tags", "headings", F.length("content").cast("bigint").alias("n_chars")),
        "excluded_paths": lambda s, d: notes(s, d).where(paths.is_excluded(F.col("path"), EXCLUDED)).select("note_id", "path").distinct(),
        "indexable_paths": lambda s, d: notes(s, d).select("path").distinct().select("path", paths.is_indexable(F.col("path"), ("md", "pdf"), EXCLUDED, ["^Journal/2023/"]).alias("indexable")),
        "path_parts": lambda s, d: notes(s, d).select("path").distinct().select("path", paths.basename(F.col("path")).alias("base"), paths.extension(F.col("path")).alias("ext"), paths.folder(F.col("path")).alias("above")),
        "view_type_lookup": lambda s, d: notes(s, d).groupBy(paths.view_type(F.col("path")).alias("view_type")).agg(F.count(F.lit(1)).alias("files")),
        "suggest_paths": lambda s, d: notes(s, d).where(paths.suggests(F.col("folder"), "garden")).select("folder").distinct(),
        "ext_histogram": lambda s, d: corpus.count_extensions(notes(s, d)),
        "corpus_size": lambda s, d: corpus.corpus_size(corpus.notes_once(notes(s, d)), "content"),
        "split_lines": lines_of,
        "metadata_join": lambda s, d: corpus.with_metadata(refs(s, d).where("engine = 'lexical'").select("ref_id", "path"), corpus.notes_once(notes(s, d)).select("path", "tags", "headings")),
        "semantic_documents": lambda s, d: semantic.semantic_documents(table(s, d, "semantic_documents")),
        "semantic_count": lambda s, d: semantic.semantic_documents(table(s, d, "semantic_documents")).groupBy("view_type").agg(F.count(F.lit(1)).alias("documents")),
        # analysis and index
        "tokenize_index": lambda s, d: index.fields(docs_of(s, d), ["content"]).select("note_id", F.explode("tokens").alias("token")),
        "token_counts": lambda s, d: index.fields(docs_of(s, d), ["content"]).select("note_id", F.size("tokens").cast("bigint").alias("n_tokens")),
        "subword_tokens": lambda s, d: docs_of(s, d).select("note_id", F.explode(text.words(F.col("content"))).alias("w")).where(F.length("w") > 3).select("note_id", "w", F.explode(text.subwords(F.col("w"))).alias("part")).where("part <> w").distinct(),
        "postings_tf": lambda s, d: index.postings(docs_of(s, d)),
        "postings_occurrences": lambda s, d: index.postings(docs_of(s, d), ["content"], count_all=True),
        "field_lengths": lambda s, d: index.field_lengths(docs_of(s, d)),
        "field_stats": lambda s, d: index.field_stats(docs_of(s, d)).withColumn("average", F.round("average", 6)),
        "doc_freq": lambda s, d: index.document_frequency(docs_of(s, d)),
        "stopword_antijoin": lambda s, d: _stop_words(s, d),
        # search
        "term_expand_exact": lambda s, d: _expansion(s, d, EXACT),
        "term_expand_prefix": lambda s, d: _expansion(s, d, PREFIX),
        "term_expand_fuzzy": lambda s, d: _expansion(s, d, FUZZY),
        "expansion_union": lambda s, d: _expansion(s, d, FULL),
        "lexical_search_exact": _searching(EXACT),
        "lexical_search_prefix": _searching(PREFIX),
        "lexical_search_fuzzy": _searching(FUZZY),
        "lexical_search_full": _searching(FULL),
        "lexical_search_wide": _searching(WIDE),
        "lexical_search_or": _searching(FULL, every_term=False, limit=50),
        "lexical_search_content": _searching(EXACT, boosts={"content": 1.0}),
        "lexical_search_tags": _searching("compost todo /np/nf", boosts=ranking.BOOSTS | {"tags": ranking.TAG_BOOST}),
        "lexical_search_empty": _searching("the /np"),
        "lexical_search_saved": _saved_search,
        "filter_matched_terms": _maximal,
        "query_commands": lambda s, d: _values(s, list(enumerate(RAW_QUERIES)), "query_id int, raw string").select("query_id", query.parsed(F.col("raw")).alias("q")).select("query_id", "q.text", "q.prefix", "q.fuzzy"),
        # lines and snippets
        "line_scores": lambda s, d: lines.matching_lines(lines_of(s, d), TERMS).select("note_id", "row_no", "score"),
        "top_lines_per_doc": lambda s, d: lines.top_lines(lines_of(s, d), TERMS).select("note_id", "row_no", "score", "rank"),
        "note_lines_top": _note_lines,
        "highlight": _highlight,
        "context_neighbours": lambda s, d: snippets.neighbours(*_hits(s, d), 2, 1),
        "context_above": lambda s, d: snippets.context_budget(*_hits(s, d), 3, 180, True),
        "context_below": lambda s, d: snippets.context_budget(*_hits(s, d), 3, 200, False),
        "snippets": _snippets,
        "truncate_limits": lambda s, d: _values(s, [(k, w, x.lines_before, x.lines_after, x.chars_before, x.chars_after, x.least) for (k, w), x in snippets.LIMITS.items()], "kind string, wide boolean, lines_before int, lines_after int, chars_before int, chars_after int, least int"),
        "in_file_prefilter": lambda s, d: lines_of(s, d).where(F.col("text").rlike(lines.subsequence_pattern("glsfur"))).select("note_id", "row_no"),
        "in_file_fuzzy": lambda s, d: lines.fuzzy_lines(lines_of(s, d), "gls fur", 30).select("note_id", "row_no", "score", F.array_join("positions", " ").alias("positions")),
        "search_in_file": lambda s, d: snippets.search_in_file(docs_of(s, d), 4, "glsfrn"),
        # scalar functions
        "markdown_clean": lambda s, d: docs_of(s, d).select("note_id", text.markdown_clean(F.col("content")).alias("clean")),
        "html_to_text": lambda s, d: docs_of(s, d).select("note_id", text.html_to_text(F.col("content")).alias("plain")),
        "heading_list": lambda s, d: docs_of(s, d).select("note_id", text.headings(F.col("content")).alias("found")),
        "url_domain": lambda s, d: _values(s, [(u,) for u in URLS], "url string").select("url", paths.url_domain(F.col("url")).alias("domain")),
        "extension_list": lambda s, d: _values(s, [(".md txt  .PDF",), ("",), ("..x y",)], "raw string").select("raw", F.array_join(paths.parse_extensions(F.col("raw")), ",").alias("extensions")),
        "format_duration": lambda s, d: _values(s, [(m,) for m in MILLIS], "ms bigint").select("ms", formatting.duration(F.col("ms")).alias("shown")),
        "percent_shares": lambda s, d: _shares(s, d),
        "response_decode": lambda s, d: _values(s, [(200, 0), (200, -1), (200, -2), (200, 7), (500, 0)], "status int, code int").select("status", "code", formatting.answer_kind(F.col("status"), F.col("code")).alias("kind")),
        "lang_stats": lambda s, d: language.proportions(lines_of(s, d), "note_id", "text"),
        "wide_char_stats": lambda s, d: docs_of(s, d).select("note_id", text.wide_count(F.col("content")).cast("bigint").alias("n_wide"), text.is_large_charset(F.col("content")).alias("large")),
        "context_marks": lambda s, d: lines.top_lines(lines_of(s, d), TERMS).select("note_id", "row_no", text.mark_literal(F.col("text"), "glass").alias("marked")),
        "tag_list": lambda s, d: corpus.notes_once(notes(s, d)).select("note_id", text.joined_tags(F.split("tags", " ")).alias("joined")),
        "result_counter": _counter,
        "old_search_in_file": lambda s, d: snippets.old_search_in_file(docs_of(s, d), 4, "glsfrn"),
        "strip_query": lambda s, d: notes(s, d).select("note_id", text.strip_spaces(F.col("basename")).alias("stripped")).distinct(),
        "line_snippets": _line_snippets,
        "match_columns": lambda s, d: lines.matching_lines(lines_of(s, d), TERMS).select("note_id", "row_no", F.array_join(lines.match_columns(F.col("text"), TERMS), " ").alias("columns")),
        "first_match_column": lambda s, d: lines_of(s, d).select("note_id", "row_no", lines.min_in_set(lines.match_columns(F.col("text"), ["glass"])).alias("first")),
        "line_scores_whole": lambda s, d: lines.matching_lines(lines_of(s, d), ["glass"], prefix=False).select("note_id", "row_no", "score"),
        "line_index_search": lambda s, d: lines.ranked_lines(lines_of(s, d), FULL, 50),
        "search_in_files": lambda s, d: lines.fuzzy_lines_each(lines_of(s, d), "glsfrn").select("note_id", "row_no", "score", "rank"),
        "result_cursor": _cursor,
        "matched_terms_of_notes": _matched_of_notes,
        "query_commands_of_notes": lambda s, d: corpus.notes_once(notes(s, d)).where("basename is not null and not startswith(basename, '/')").select("note_id", query.parsed(F.concat(F.lit("/ap/nf "), "basename", F.lit(" /np"))).alias("q")).select("note_id", "q.text", "q.prefix", "q.fuzzy"),
        "url_domains": lambda s, d: table(s, d, "supplier").select("s_suppkey", paths.url_domain(_url()).alias("domain")),
        "url_build": lambda s, d: table(s, d, "customer").select("c_custkey", formatting.query_string("http://host/search", {"queryText": F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))), "segment": F.col("c_mktsegment")}).alias("url")),
        "durations": lambda s, d: table(s, d, "events").select("event_id", formatting.duration(F.col("event_id") * 37).alias("shown")),
        "extension_lists": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(paths.parse_extensions(F.concat(F.lit(" ."), "p_name", F.lit("  ..x"))), ",").alias("extensions")),
        "answer_kinds": lambda s, d: table(s, d, "events").select("event_id", formatting.answer_kind(F.when(F.col("user_id") % 7 == 0, 500).otherwise(200), (F.col("event_id") % 4).cast("int") - 2).alias("kind")),
        "array_append": lambda s, d: corpus.notes_once(notes(s, d)).select("note_id", F.array_join(F.concat(F.split("tags", " "), F.split("headings", " ")), "|").alias("joined")),
        "front_matter_tags": lambda s, d: docs_of(s, d).select("note_id", F.array_join(text.front_matter(F.concat(F.lit("---\ntitle: x\ntags: ["), F.regexp_replace("tags", " ", ", "), F.lit("]\n---\n"), F.coalesce("content", F.lit(""))), "tags"), "|").alias("found")),
        # stores and sources
        "lexical_search_limit": _searching(FULL, limit=300),
        "lexical_search_case": _searching("Glass fu /nf", analysis=text.Analysis(case_sensitive=True)),
        "lexical_search_all_words": _searching("the glass /np/nf", analysis=text.Analysis(stop_words_en=())),
        "lexical_search_own_words": _searching("glass harbour /np/nf", analysis=text.Analysis(stop_words_en=("glass", "and"))),
        "index_after_changes": _changed_index,
        "saved_refs": _saved_refs,
        "vector_upkeep": _vectors_kept,
        "stale_versions": _stale,
        "file_sources": _file_sources,
        "buffer_flushes": _flushes,
        "semantic_passages": _passages,
        # maintenance
        "refs_diff": lambda s, d: maintain.diff(times(s, d), refs(s, d).where("engine = 'lexical'")),
        "refs_diff_semantic": lambda s, d: maintain.diff(times(s, d), refs(s, d).where("engine = 'semantic'")),
        "stale_refs": lambda s, d: maintain.stale_refs(refs(s, d), times(s, d)),
        "new_docs": lambda s, d: corpus.not_indexed(notes(s, d).select("path").distinct(), refs(s, d).where("engine = 'semantic'")),
        "existing_docs": lambda s, d: corpus.indexed_only(notes(s, d).select("path").distinct(), refs(s, d).where("engine = 'semantic'")),
        "new_exclusions": lambda s, d: corpus.new_exclusions(refs(s, d).select("path"), notes(s, d).where("folder = 'Inbox/'"), notes(s, d)),
        "change_ops_expand": lambda s, d: maintain.expand_events(_events(s, d)),
        "change_log_lww": lambda s, d: maintain.pending(ops(s, d)),
        "net_change": lambda s, d: maintain.net_change(ops(s, d)),
        "apply_changes": _present,
        "change_stream_apply": _stream,
        "last_query": _last_query,
        # vectors
        "semantic_topk": _first_vector,
        "semantic_topk_each": _every_hundredth_vector,
    }


def _url() -> Column:
    scheme = F.when(F.col("s_nationkey") % 3 == 0, "http://").when(F.col("s_nationkey") % 3 == 1, "https://").otherwise("")
    return F.concat(scheme, F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example:80/a?b="), "s_suppkey")


def _expansion(spark: SparkSession, d: str, raw: str) -> DataFrame:
    return search.expansion(_vocabulary(spark, d), raw).withColumn("weight", F.round("weight", 6))


def _stop_words(spark: SparkSession, d: str) -> DataFrame:
    words = docs_of(spark, d).select(F.explode(text.words(F.col("content"), [])).alias("word"))
    stop = F.broadcast(_values(spark, [(w,) for w in text.STOP_WORDS_EN], "word string"))
    return words.join(stop, "word", "left_anti").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _shares(spark: SparkSession, d: str) -> DataFrame:
    per = corpus.notes_once(table(spark, d, "indexed_documents")).groupBy("vault").agg(F.count(F.lit(1)).alias("n"), F.count("content").alias("k"))
    return per.select("vault", formatting.percent(F.col("k") / F.col("n")).alias("with_content"))


def oracle_sql() -> dict[str, str]:
    out = dict(SQL)
    for name, op in (("net_change", None), ("change_stream_apply", None)):
        out[name] = OPS + "SELECT vault, path, op, op_time FROM (SELECT *, row_number() OVER (PARTITION BY vault, path ORDER BY op_time DESC NULLS LAST, op_id DESC) AS r FROM ops) WHERE r = 1"
    return out


D = f"WITH {S.DOCS} "
LINES = f"WITH {S.DOCS}, line AS (SELECT note_id, i - 1 AS row_no, string_split(content, chr(10))[i] AS text FROM docs, unnest(range(1, length(string_split(content, chr(10))) + 1)) AS g(i) WHERE content IS NOT NULL)"
SCORE = f"""{LINES},
found AS (SELECT note_id, row_no, unnest(regexp_extract_all(text, '(?i)furnace') || regexp_extract_all(text, '(?i)glass') || regexp_extract_all(text, '(?i)harbour')) AS form FROM line),
score AS (SELECT note_id, row_no, round(sum(length(form) + 0.01 * (n - 1)), 4)::DOUBLE AS score FROM (SELECT note_id, row_no, form, count(*) AS n FROM found GROUP BY ALL) GROUP BY ALL)"""
OPS = """WITH spelt AS (SELECT DISTINCT vault, path, CASE WHEN lower(trim(op)) IN ('add', 'added', 'create') THEN 'add' WHEN lower(trim(op)) IN ('delete', 'del', 'deleted', 'remove') THEN 'delete' END AS op, op_time, op_id FROM change_ops WHERE path IS NOT NULL),
ops AS (SELECT * FROM spelt WHERE op IS NOT NULL) """
FILES = "f AS (SELECT path, max(indexed_at) AS t FROM indexed_documents WHERE path IS NOT NULL GROUP BY path)"
DIFF = """WITH """ + FILES + """, r AS (SELECT path, max(update_time) AS t FROM doc_refs WHERE path IS NOT NULL AND engine = '{0}' GROUP BY path),
j AS (SELECT coalesce(f.path, r.path) AS path, f.path IS NOT NULL AS is_now, r.path IS NOT NULL AS was, coalesce(f.t > r.t, false) AS newer FROM f FULL JOIN r ON f.path = r.path)
SELECT path, 'add' AS op FROM j WHERE is_now AND (NOT was OR newer) UNION ALL SELECT path, 'delete' FROM j WHERE was AND (NOT is_now OR newer)"""
HITS = SCORE + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, row_no) AS rank FROM score)"
NEAR = HITS + ", hits AS (SELECT note_id, row_no AS hit_row FROM ranked WHERE rank <= 30)"


def _budget(rows: int, budget: int, upwards: bool) -> str:
    near = f"l.row_no BETWEEN hit_row - {rows} AND hit_row - 1" if upwards else f"l.row_no BETWEEN hit_row + 1 AND hit_row + {rows}"
    cut = f"substr(text, greatest(length(text) - ({budget} - used), 0)::BIGINT + 1)" if upwards else f"substr(text, 1, ({budget} - used)::BIGINT)"
    return f"""{NEAR}, near AS (SELECT h.note_id, hit_row, l.row_no, text, coalesce(sum(length(text)) OVER (PARTITION BY h.note_id, hit_row ORDER BY l.row_no {'DESC' if upwards else 'ASC'} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM hits h JOIN line l ON l.note_id = h.note_id AND {near})
SELECT note_id, hit_row, row_no, CASE WHEN length(text) < {budget} - used THEN text ELSE {cut} END AS text FROM near WHERE used < {budget}"""


def _expand(terms: list[str], prefix: bool, fuzzy: bool) -> str:
    return f"{S.INDEX}, {S.expansions(terms, prefix, fuzzy)} SELECT term, query_term, kind, round(weight, 6) AS weight FROM expand"


TAGGED = S.BOOST.replace(" END", " WHEN 'tags' THEN 1.15 END")
TAG_SEARCH = S.search(["compost", "todo"], False, False, 30, boosts=TAGGED).replace("SELECT note_id, 'content' AS field", "SELECT note_id, 'tags' AS field, tags AS txt FROM docs UNION ALL SELECT note_id, 'content' AS field", 1)
VIEW = "CASE " + " ".join(f"WHEN {S.EXT} IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in paths.VIEW_TYPES.items()) + " ELSE 'unsupported' END"
EXCLUDE = "(" + " OR ".join(f"path = '{e}' OR starts_with(path, '{e}/')" for e in EXCLUDED) + ")"
CLEAN = "regexp_replace(regexp_replace(regexp_replace({0}, '\\[([^\\[\\]]+)\\]\\([^()]*\\)', '\\1', 'g'), '\\*\\*(.*?)\\*\\*', '\\1', 'g'), '`(.*?)`', '\\1', 'g')"
PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?i)<br\\s*/?>|</(?:p|div|li|tr|h[1-6]|table|ul|ol)\\s*>', chr(10), 'g'), '</?[A-Za-z][^<>]*>', '', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    PLAIN = f"replace({PLAIN}, '{_entity}', '{_sign}')"
LANG = "CASE WHEN length(text) < 10 OR la + wi = 0 THEN 'other' WHEN wi > la THEN 'zh' ELSE 'en' END"


def _rows(values: list[str], columns: str) -> str:
    return f"(VALUES {', '.join(values)}) AS v({columns})"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ONE = LINES + ", hit AS (SELECT note_id, row_no, text, strpos(lower(text), 'furnace') - 1 AS spot, len(regexp_extract_all(text, '(?i)furnace')) AS n, sum(1) OVER () AS one FROM line WHERE regexp_matches(text, '(?i)furnace')), scored AS (SELECT *, (SELECT sum(length(f) + 0.01 * (k - 1)) FROM (SELECT f, count(*) AS k FROM (SELECT unnest(regexp_extract_all(text, '(?i)furnace')) AS f) GROUP BY f)) AS score FROM hit), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY round(score, 4) DESC, row_no) AS r FROM scored) WHERE r <= 30)"
ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
MARKED = "regexp_replace(" + ESCAPED + ", '(?i)(furnace)', '<mark>\\1</mark>', 'g')"
COVER = "list_sort(list_distinct(flatten([" + ", ".join(f"flatten(list_transform(list_filter(range(0, length(text)), lambda i: substr(lower(text), i + 1, {len(t)}) = '{t}'), lambda i: range(i, i + {len(t)})))" for t in TERMS) + "])))"


def _window(before: int, after: int) -> str:
    """The hits of one term with the slice of the line in which it's marked, ``low`` and ``high``."""
    return f"{ONE}, cut AS (SELECT *, greatest(0, spot - {before}) AS low, least(length(text), spot + 7 + {after}) AS high FROM top)"


def _case_search(terms: list[str], prefix: bool) -> str:
    return S.search(terms, prefix, False, 30).replace("lower(token) AS term", "token AS term")


def _own_words(raw: list[str], old: str, new: str) -> str:
    return S.search(raw, False, False, 30).replace(f"w NOT IN ({old})", new)


LINE_DOCS = f"{LINES}, docs2 AS (SELECT note_id * 10000000 + row_no AS note_id, text FROM line), fields AS (SELECT note_id, 'text' AS field, text AS txt FROM docs2),{S.tokens('fields')},\npost AS (SELECT note_id, field, lower(token) AS term, count(*) AS tf FROM tok GROUP BY ALL),\nlens AS (SELECT f.note_id, f.field, count(t.token) AS length FROM fields f LEFT JOIN tok t ON t.note_id = f.note_id AND t.field = f.field GROUP BY ALL)"
PASSAGES = f"""WITH {S.DOCS}, passage AS (SELECT path, i - 1 AS chunk_no, parts[i] AS text FROM (SELECT path, list_filter(list_transform(regexp_split_to_array(content, '\\n[^\\S\\n]*\\n'), lambda p: regexp_replace(p, '^[\\s\\x0b\\p{{Z}}]+|[\\s\\x0b\\p{{Z}}]+$', '', 'g')), lambda p: p <> '') AS parts FROM docs WHERE content IS NOT NULL), unnest(range(1, length(parts) + 1)) AS g(i)),
body AS (SELECT path || chr(0) || chunk_no AS note_id, 'text' AS field, text AS txt FROM passage UNION ALL SELECT '?', 'text', 'glass furnace kiln'),{S.tokens('body')},
hashed AS (SELECT note_id, ('0x' || substr(md5(lower(token)), 1, 6))::BIGINT AS h FROM tok),
vector AS (SELECT note_id, h % 64 AS place, sum(CASE WHEN h // 64 % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM hashed GROUP BY ALL),
size AS (SELECT note_id, sqrt(sum(v * v)) AS norm FROM vector GROUP BY ALL HAVING sum(v * v) > 0),
near AS (SELECT s.note_id, round(coalesce(sum(a.v * q.v), 0) / (s.norm * (SELECT norm FROM size WHERE note_id = '?')), 6) AS similarity FROM size s LEFT JOIN vector a ON a.note_id = s.note_id LEFT JOIN vector q ON q.note_id = '?' AND q.place = a.place WHERE s.note_id <> '?' GROUP BY s.note_id, s.norm),
top AS (SELECT split_part(note_id, chr(0), 1) AS path, split_part(note_id, chr(0), 2)::INT AS chunk_no, similarity FROM near ORDER BY similarity DESC, path, chunk_no LIMIT 30)
SELECT path, row_number() OVER (ORDER BY max(similarity) DESC, path) AS rank, max(similarity) AS similarity, count(*) AS n_items FROM top GROUP BY path"""

SQL = {
    "line_snippets": _window(30, 230) + f""", part AS (SELECT *, CASE WHEN spot < 30 THEN 0 ELSE spot - 30 END AS start, least(length(text) - 1, spot + 230) AS last FROM cut)
SELECT note_id, row_no, spot AS col, '<span class="matched-line">' || {MARKED.format("substr(text, start + 1, least(high, last + 1) - start)")} || {ESCAPED.format("substr(text, least(high, last + 1) + 1, last + 1 - least(high, last + 1))")} || '</span>' AS snippet FROM part""",
    "highlight": _window(180, 200) + f", m AS (SELECT *, list_sort(flatten(list_transform(list_filter(range(low, high - 6), lambda i: substr(lower(text), i + 1, 7) = 'furnace'), lambda i: range(i, i + 7)))) AS cols FROM cut) SELECT note_id, row_no, array_to_string(cols, ' ') AS columns, {ESCAPED.format('substr(text, 1, low)')} || {MARKED.format('substr(text, low + 1, high - low)')} || {ESCAPED.format('substr(text, high + 1)')} AS marked FROM m",
    "match_columns": LINES + f" SELECT note_id, row_no, array_to_string({COVER}, ' ') AS columns FROM line WHERE regexp_matches(text, '(?i)furnace|glass|harbour')",
    "first_match_column": LINES + " SELECT note_id, row_no, CASE WHEN contains(lower(text), 'glass') THEN (strpos(lower(text), 'glass') - 1)::DOUBLE ELSE 1.7976931348623157e308 END AS first FROM line",
    "line_scores_whole": LINES + ", found AS (SELECT note_id, row_no, unnest(regexp_extract_all(text || ' ', '(?i)(glass)[^A-Za-z]', 1)) AS form FROM line) SELECT note_id, row_no, round(sum(length(form) + 0.01 * (n - 1)), 4)::DOUBLE AS score FROM (SELECT note_id, row_no, form, count(*) AS n FROM found GROUP BY ALL) GROUP BY ALL",
    "line_index_search": "SELECT note_id // 10000000 AS note_id, (note_id % 10000000)::INT AS row_no, rank, score, query_terms, matched_terms FROM (" + S.search(["glas", "furn"], True, True, 50, every_term=False, boosts="1.0").replace(S.INDEX, LINE_DOCS).replace("n AS (SELECT count(*) AS n FROM docs)", "n AS (SELECT count(*) AS n FROM docs2)").replace("SELECT note_id, path, row_number()", "SELECT note_id, row_number()").replace("FROM top JOIN docs USING (note_id)", "FROM top") + ")",
    "result_cursor": "WITH r AS (" + S.search(["glas", "furn"], True, True, 30) + ") SELECT note_id, greatest(0, rank - 2) AS before, least((SELECT count(*) FROM r) - 1, rank) AS behind FROM r",
    "matched_terms_of_notes": S.CONTENT + """, t AS (SELECT note_id, list_sort(list(DISTINCT lower(token))) AS m FROM tok WHERE regexp_matches(lower(token), '^(gla|fur)') GROUP BY note_id),
k AS (SELECT note_id, m, list_filter(['glass', 'furnace'], lambda q: list_contains(m, q)) AS kept FROM t)
SELECT note_id, array_to_string(CASE WHEN len(kept) = 0 THEN list_filter(m, lambda x: len(list_filter(m, lambda o: length(o) > length(x) AND contains(o, x))) = 0) ELSE kept || list_filter(m, lambda x: NOT list_contains(kept, x) AND len(list_filter(kept, lambda o: contains(o, x) OR contains(x, o))) = 0) END, ' ') AS terms FROM k""",
    "query_commands_of_notes": f"WITH {S.NOTES} SELECT note_id, basename AS text, false AS prefix, false AS fuzzy FROM notes WHERE basename NOT LIKE '/%'",
    "url_domains": "SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE lower(replace(s_name, '#', '-')) || '.example:80' END AS domain FROM supplier",
    "url_build": "SELECT c_custkey, 'http://host/search?queryText=' || replace(url_encode(c_name), '%20', '+') || '&segment=' || replace(url_encode(c_mktsegment), '%20', '+') AS url FROM customer",
    "durations": "SELECT event_id, CASE WHEN ms < 1000 THEN format('{} ms', ms) WHEN ms < 60000 THEN format('{} s {} ms', ms // 1000, ms % 1000) ELSE format('{} min {} s {} ms', ms // 60000, ms // 1000 % 60, ms % 1000) END AS shown FROM (SELECT event_id, event_id * 37 AS ms FROM events)",
    "extension_lists": "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' ') || ['.x'], lambda e: e <> ''), ',') AS extensions FROM part",
    "answer_kinds": "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'error' WHEN event_id % 4 = 2 THEN 'data' WHEN event_id % 4 < 2 THEN 'absent' ELSE 'error' END AS kind FROM events",
    "array_append": f"WITH {S.NOTES} SELECT note_id, CASE WHEN tags IS NOT NULL AND headings IS NOT NULL THEN array_to_string(list_concat(string_split(tags, ' '), string_split(headings, ' ')), '|') END AS joined FROM notes",
    "front_matter_tags": D + "SELECT note_id, array_to_string(list_filter(string_split(tags, ' '), lambda t: t <> ''), '|') AS found FROM docs",
    "lexical_search_limit": S.search(["glas", "furn"], True, True, 300),
    "lexical_search_case": _case_search(["Glass", "fu"], True),
    "lexical_search_all_words": _own_words(["the", "glass"], S._list(text.STOP_WORDS_EN), "true"),
    "lexical_search_own_words": _own_words(["harbour"], S._list(text.STOP_WORDS_EN), "w NOT IN ('glass', 'and')"),
    "index_after_changes": S.INDEX + ", " + OPS.removeprefix("WITH ") + ", net AS (SELECT vault, path, op FROM (SELECT *, row_number() OVER (PARTITION BY vault, path ORDER BY op_time DESC NULLS LAST, op_id DESC) AS r FROM ops) WHERE r = 1) SELECT d.note_id, d.path, (SELECT count(*) FROM post p WHERE p.note_id = d.note_id) AS n_postings FROM docs d WHERE NOT EXISTS (SELECT 1 FROM net WHERE net.vault IS NOT DISTINCT FROM d.vault AND net.path = d.path AND op = 'delete')",
    "saved_refs": f"SELECT engine, path, max(indexed_at) AS update_time FROM indexed_documents, (VALUES ('lexical'), ('semantic')) AS e(engine) WHERE {S.EXT} = 'md' AND NOT contains(path, 'excalidraw.md') GROUP BY engine, path",
    "vector_upkeep": "SELECT CAST(vec_id AS VARCHAR) AS path, len(embedding) AS numbers FROM embeddings WHERE label <> 1",
    "stale_versions": "SELECT * FROM (VALUES ('v1'), ('v2')) AS v(version)",
    "file_sources": "SELECT n_nationkey, n_name || chr(10) || n_regionkey || chr(10) AS content, octet_length(encode(n_name || chr(10) || n_regionkey || chr(10))) AS size FROM nation",
    "semantic_passages": PASSAGES,
    "index_documents_scan": D + "SELECT note_id, path, basename, folder, aliases, tags, headings, length(content) AS n_chars FROM docs",
    "excluded_paths": f"SELECT DISTINCT note_id, path FROM indexed_documents WHERE {EXCLUDE}",
    "indexable_paths": f"SELECT DISTINCT path, {S.EXT} IN ('md', 'pdf') AND NOT contains(path, 'excalidraw.md') AND NOT {EXCLUDE} AND NOT regexp_matches(path, '^Journal/2023/') AS indexable FROM indexed_documents",
    "path_parts": f"SELECT DISTINCT path, {S.BASE} AS base, {S.EXT} AS ext, CASE WHEN contains(path, '/') AND regexp_extract(path, '^(.*/)[^/]*$', 1) <> '/' THEN regexp_extract(path, '^(.*/)[^/]*$', 1) ELSE './' END AS above FROM indexed_documents",
    "view_type_lookup": f"SELECT {VIEW} AS view_type, count(*) AS files FROM indexed_documents GROUP BY 1",
    "suggest_paths": "SELECT DISTINCT folder FROM indexed_documents WHERE contains(lower(folder), 'garden')",
    "ext_histogram": f"SELECT CASE WHEN coalesce({S.EXT}, '') = '' THEN 'no_extension' ELSE {S.EXT} END AS extension, count(*) AS files FROM indexed_documents GROUP BY 1",
    "corpus_size": f"WITH {S.NOTES} SELECT count(*) AS files, sum(octet_length(encode(content)))::BIGINT AS bytes, round(sum(octet_length(encode(content))) / 1024, 2) AS kb, round(sum(octet_length(encode(content))) / 1048576, 2) AS mb, sum(octet_length(encode(content))) > 2000 * 1024 AS large FROM notes",
    "split_lines": LINES + "SELECT note_id, row_no, text FROM line",
    "metadata_join": f"WITH {S.NOTES}, one AS (SELECT path, any_value(coalesce(tags, '')) AS tags, any_value(coalesce(headings, '')) AS headings FROM notes GROUP BY path) SELECT ref_id, r.path, coalesce(tags, '') AS tags, coalesce(headings, '') AS headings FROM doc_refs r LEFT JOIN one ON r.path = one.path WHERE engine = 'lexical'",
    "semantic_documents": "SELECT DISTINCT path, view_type, content FROM semantic_documents",
    "semantic_count": "SELECT view_type, count(*) AS documents FROM (SELECT DISTINCT path, view_type, content FROM semantic_documents) GROUP BY 1",
    "tokenize_index": S.CONTENT + " SELECT note_id, token FROM tok",
    "token_counts": S.CONTENT + " SELECT note_id, count(token) AS n_tokens FROM docs LEFT JOIN tok USING (note_id) GROUP BY ALL",
    "subword_tokens": S.CONTENT + ", p AS (SELECT note_id, w, unnest(string_split(regexp_replace(regexp_replace(w, '[-_]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ')) AS part FROM kept WHERE length(w) > 3) SELECT DISTINCT note_id, w, part FROM p WHERE length(part) > 1 AND part <> w",
    "postings_tf": S.INDEX + " SELECT note_id, field, term, tf FROM post",
    "postings_occurrences": S.CONTENT + f""", every AS (SELECT note_id, field, w FROM kept UNION ALL
  SELECT note_id, field, w FROM (SELECT note_id, field, unnest(string_split(regexp_replace(regexp_replace(w, '[-_]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ')) AS w FROM kept WHERE length(w) > 3 AND regexp_matches(w, '[-_]|[a-z][A-Z]')) WHERE length(w) > 1 UNION ALL
  SELECT note_id, field, w FROM pair WHERE w NOT IN ({S._list(text.STOP_WORDS_ZH)}))
SELECT note_id, field, lower(w) AS term, count(*) AS tf FROM every WHERE length(w) < 30 GROUP BY ALL""",
    "field_lengths": S.INDEX + " SELECT note_id, field, length FROM lens",
    "field_stats": S.INDEX + " SELECT field, count(*) AS documents, round(avg(length), 6) AS average FROM lens GROUP BY field",
    "doc_freq": S.INDEX + " SELECT term, field, count(*) AS df FROM post GROUP BY ALL",
    "stopword_antijoin": S.CONTENT + f" SELECT w AS word, count(*) AS n FROM word WHERE length(w) >= 2 AND w NOT IN ({S._list(text.STOP_WORDS_EN)}) GROUP BY w",
    "term_expand_exact": _expand(["reed", "harvest"], False, False),
    "term_expand_prefix": _expand(["harb", "fe"], True, False),
    "term_expand_fuzzy": _expand(["glas", "furnase"], False, True),
    "expansion_union": _expand(["glas", "furn"], True, True),
    "lexical_search_exact": S.search(["reed", "harvest"], False, False, 30),
    "lexical_search_prefix": S.search(["harb", "fe"], True, False, 30),
    "lexical_search_fuzzy": S.search(["glas", "furnase"], False, True, 30),
    "lexical_search_full": S.search(["glas", "furn"], True, True, 30),
    "lexical_search_wide": S.search(["潮汐"], True, True, 30),
    "lexical_search_or": S.search(["glas", "furn"], True, True, 50, every_term=False),
    "lexical_search_content": S.search(["reed", "harvest"], False, False, 30, fields="field = 'content'"),
    "lexical_search_tags": TAG_SEARCH,
    "lexical_search_saved": "SELECT note_id, score FROM (" + S.search(["glas", "furn"], True, True, 30) + ")",
    "filter_matched_terms": "SELECT * FROM " + _rows(["(0, 'foobar')", "(1, 'abc xab')", "(2, 'pq')", "(3, 'ab')"], "case_id, terms"),
    "query_commands": "SELECT * FROM " + _rows(["(0, 'something', false, false)", "(1, '', true, true)", "(2, 'plain words', true, true)", "(3, '', false, true)", "(4, '', true, true)", "(5, 'a  b', true, true)", "(6, 'x', false, false)", "(7, 'x', true, true)"], "query_id, text, prefix, fuzzy"),
    "line_scores": SCORE + " SELECT note_id, row_no, score FROM score",
    "top_lines_per_doc": HITS + " SELECT note_id, row_no, score, rank FROM ranked WHERE rank <= 30",
    "note_lines_top": """WITH line AS (SELECT note_id, row_no, any_value(vault) AS vault, any_value(text) AS text FROM note_lines GROUP BY ALL),
found AS (SELECT vault, note_id, row_no, unnest(regexp_extract_all(text, '(?i)furnace') || regexp_extract_all(text, '(?i)glass') || regexp_extract_all(text, '(?i)harbour')) AS form, text FROM line),
score AS (SELECT vault, note_id, row_no, text, round(sum(length(form) + 0.01 * (n - 1)), 4)::DOUBLE AS score FROM (SELECT vault, note_id, row_no, text, form, count(*) AS n FROM found GROUP BY ALL) GROUP BY ALL)
SELECT vault, note_id, row_no, score FROM (SELECT *, row_number() OVER (PARTITION BY vault ORDER BY score DESC, row_no, text, note_id) AS r FROM score) WHERE r <= 30""",
    "lexical_search_empty": "SELECT note_id, path, 1 AS rank, 0.0::DOUBLE AS score, '' AS query_terms, '' AS matched_terms FROM indexed_documents WHERE false",
    "context_neighbours": NEAR + " SELECT h.note_id, hit_row, l.row_no, text FROM hits h JOIN line l ON l.note_id = h.note_id AND l.row_no BETWEEN hit_row - 2 AND hit_row + 1",
    "context_above": _budget(3, 180, True),
    "context_below": _budget(3, 200, False),
    "truncate_limits": "SELECT * FROM " + _rows(["('line', false, 0, 0, 30, 230, 4)", "('line', true, 0, 0, 30, 230, 4)", "('paragraph', false, 4, 7, 220, 600, 4)", "('paragraph', true, 4, 7, 220, 600, 4)", "('subItem', false, 3, 3, 180, 200, 4)", "('subItem', true, 3, 3, 60, 80, 4)"], "kind, wide, lines_before, lines_after, chars_before, chars_after, least"),
    "in_file_prefilter": LINES + " SELECT note_id, row_no FROM line WHERE regexp_matches(text, '(?is)g.*?l.*?s.*?f.*?u.*?r')",
    "markdown_clean": D + f"SELECT note_id, {CLEAN.format('content')} AS clean FROM docs",
    "html_to_text": D + f"SELECT note_id, {CLEAN.format(PLAIN)} AS plain FROM docs",
    "heading_list": D + "SELECT note_id, array_to_string(regexp_extract_all(content, '(?m)^#{1,6}[ \\t]+(.*?)[ \\t#]*\\r?$', 1), ' ') AS found FROM docs",
    "url_domain": "SELECT * FROM " + _rows(["('https://example.org/a/b?c=1', 'example.org')", "('http://example.org/a', '')", "('example.org/x', 'example.org')", "('https://a.b.example:8080/', 'a.b.example:8080')", "('', '')"], "url, domain"),
    "extension_list": "SELECT * FROM " + _rows(["('.md txt  .PDF', 'md,txt,PDF')", "('', '')", "('..x y', '.x,y')"], "raw, extensions"),
    "format_duration": "SELECT ms::BIGINT AS ms, CASE WHEN ms < 1000 THEN format('{} ms', ms) WHEN ms < 60000 THEN format('{} s {} ms', ms // 1000, ms % 1000) ELSE format('{} min {} s {} ms', ms // 60000, ms // 1000 % 60, ms % 1000) END AS shown FROM " + _rows([f"({m})" for m in MILLIS], "ms"),
    "percent_shares": f"WITH {S.NOTES} SELECT vault, format('{{:.2f}}%', round(count(content) / count(*) * 100, 2)) AS with_content FROM notes GROUP BY vault",
    "response_decode": "SELECT * FROM " + _rows(["(200, 0, 'data')", "(200, -1, 'absent')", "(200, -2, 'absent')", "(200, 7, 'error')", "(500, 0, 'error')"], "status, code, kind"),
    "lang_stats": LINES + f""", m AS (SELECT note_id, text, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS la, length(text) - length(regexp_replace(text, '[一-龥]', '', 'g')) AS wi FROM line),
l AS (SELECT note_id, {LANG} AS lang, length(text) AS n FROM m),
t AS (SELECT note_id, coalesce(sum(n) FILTER (lang = 'en'), 0) AS a, coalesce(sum(n) FILTER (lang = 'zh'), 0) AS b, coalesce(sum(n) FILTER (lang = 'other'), 0) AS c FROM l GROUP BY note_id)
SELECT note_id, CASE WHEN a + b + c = 0 THEN 'other' WHEN a >= greatest(b, c) THEN 'en' WHEN b >= c THEN 'zh' ELSE 'other' END AS main,
  CASE WHEN a + b + c > 0 THEN format('{{:.2f}}%', round(a * 100.0 / (a + b + c), 2)) END AS en, CASE WHEN a + b + c > 0 THEN format('{{:.2f}}%', round(b * 100.0 / (a + b + c), 2)) END AS zh, CASE WHEN a + b + c > 0 THEN format('{{:.2f}}%', round(c * 100.0 / (a + b + c), 2)) END AS other FROM t""".replace("{{:.2f}}", "{:.2f}"),
    "wide_char_stats": D + "SELECT note_id, length(content) - length(regexp_replace(content, '[一-龥]', '', 'g')) AS n_wide, length(content) - length(regexp_replace(content, '[一-龥]', '', 'g')) >= ceil(0.35 * length(content)) AS large FROM docs",
    "strip_query": "SELECT DISTINCT note_id, regexp_replace(basename, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]', '', 'g') AS stripped FROM indexed_documents",
    "context_marks": HITS + " SELECT note_id, row_no, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(glass)', '<mark>\\1</mark>', 'g') AS marked FROM ranked JOIN line USING (note_id, row_no) WHERE rank <= 30",
    "tag_list": f"WITH {S.NOTES} SELECT note_id, array_to_string(list_transform(string_split(tags, ' '), lambda t: regexp_replace(t, '^#', '')), ' ') AS joined FROM notes",
    "result_counter": "WITH r AS (" + S.search(["glas", "furn"], True, True, 30) + ") SELECT note_id, format('{} / {}', rank, (SELECT count(*) FROM r)) AS shown FROM r",
    "refs_diff": DIFF.format("lexical"),
    "refs_diff_semantic": DIFF.format("semantic"),
    "stale_refs": "WITH " + FILES + ", r AS (SELECT engine, path, max(update_time) AS t FROM doc_refs WHERE path IS NOT NULL GROUP BY ALL) SELECT engine, r.path, CASE WHEN f.path IS NULL THEN 'missing' WHEN r.t IS NULL OR f.t > r.t THEN 'newer' ELSE 'current' END AS state FROM r LEFT JOIN f ON r.path = f.path",
    "new_docs": "SELECT DISTINCT path FROM indexed_documents i WHERE NOT EXISTS (SELECT 1 FROM doc_refs r WHERE r.path = i.path AND engine = 'semantic')",
    "existing_docs": "SELECT DISTINCT path FROM indexed_documents i WHERE EXISTS (SELECT 1 FROM doc_refs r WHERE r.path = i.path AND engine = 'semantic')",
    "new_exclusions": "SELECT DISTINCT path FROM doc_refs r WHERE length(path) > 0 AND NOT EXISTS (SELECT 1 FROM indexed_documents i WHERE i.path = r.path AND folder = 'Inbox/') AND EXISTS (SELECT 1 FROM indexed_documents i WHERE i.path = r.path)",
    "change_ops_expand": "WITH e AS (SELECT event_type, format('user_{}.md', user_id) AS path, ts AS op_time FROM events) SELECT path, 'add' AS op, op_time FROM e WHERE event_type <> 'error' UNION ALL SELECT CASE event_type WHEN 'purchase' THEN 'old_' || path ELSE path END, 'delete', op_time FROM e WHERE event_type <> 'signup'",
    "change_log_lww": OPS + "SELECT vault, path, op, op_time, op_id FROM (SELECT *, row_number() OVER (PARTITION BY vault, path, op ORDER BY op_time DESC NULLS LAST, op_id DESC) AS r FROM ops) WHERE r = 1",
    "apply_changes": OPS + ", net AS (SELECT vault, path, op FROM (SELECT *, row_number() OVER (PARTITION BY vault, path ORDER BY op_time DESC NULLS LAST, op_id DESC) AS r FROM ops) WHERE r = 1) SELECT vault, path FROM (SELECT vault, path FROM indexed_documents WHERE path IS NOT NULL UNION SELECT vault, path FROM net WHERE op = 'add') p WHERE NOT EXISTS (SELECT 1 FROM net WHERE net.vault = p.vault AND net.path = p.path AND op = 'delete')",
    "last_query": "SELECT arg_max(props, event_id) AS query FROM events",
    "semantic_topk_each": "SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)) WHERE r <= 10",
    "semantic_topk": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10",
}
