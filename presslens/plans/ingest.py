"""Queries on sources, cleaning, selection and sampling (families A, B, C, E, G, H of the inventory)."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from presslens.functions import text as X
from presslens.operators import sampling as G
from presslens.session import norm_source, spread, table
from presslens.sources import connectors, io
from presslens.storage import materialize, shared_dir

ARTICLES, NER, TOPICS = "romanian_political_articles_v2_shuffled", "romanian_political_articles_v2_ner", "romanian_political_articles_v2_nlp_with_topics"
# The words of the search expression, each looked for in text, title and url; url parts that exclude; and its dates.
WORDS = (
    "politica guvern parlament presedinte ministru partid senat PSD PNL UDMR AUR Gavrila Ciolacu Lasconi Ciuca vot alegeri sondaj electoral AEP Sosoaca SOS USR justitie coruptie sanitate UE NATO waiver Schengen Soros"
).split() + ["Nicusor Dan", "Calin Georgescu", "George Simion", "turul doi"]
EXCLUDED = "pagina page cookie confidentialitate video tag/ category/ contact/ despre/ autor/ categorie/ author/".split()
AFTER, BEFORE = "2023-01-01", "2026-01-01"


def _path(spark, name):
    import uuid

    return f"{shared_dir(spark)}/presslens/{name}-{uuid.uuid4().hex}"


def articles_csv(spark, sf_dir):
    """Articles written as CSV and read back."""
    path = _path(spark, "csv")
    io.write_csv(table(spark, sf_dir, ARTICLES).select(*io.FIELDS), path)
    return io.read_articles_csv(spark, path)


def url_lines(spark, sf_dir):
    """Urls appended to a line file twice and read back."""
    path = _path(spark, "lines")
    urls = table(spark, sf_dir, ARTICLES).select("url").where("url is not null")
    io.append_lines(urls, path)
    io.append_lines(urls, path)
    return io.read_lines(spark, path).groupBy("value").agg(F.count("*").alias("n")).withColumnRenamed("value", "url")


def deduped_lines(spark, sf_dir):
    """A line file rewritten in place without repeated lines."""
    path = _path(spark, "lines")
    io.append_lines(table(spark, sf_dir, ARTICLES).select("url").where("url is not null"), path)
    io.rewrite_lines(spark, path)
    return io.read_lines(spark, path).withColumnRenamed("value", "url")


def search_links(spark, sf_dir):
    """A search source over pages of links that ends at the first empty page."""
    return connectors.search(spark, lambda page: [f"https://example.org/{page}/{i % 7}" for i in range(10)] if page < 4 else [])


def fetched_articles(spark, sf_dir):
    """Articles fetched for each distinct url by an injected callable that fails for some."""

    def fetch(url):
        if url.endswith("/amp"):
            raise ValueError("no page")
        return {"title": url.rsplit("/", 1)[-1], "authors": ["A", "B"], "source_domain": url.split("/")[2]}

    return connectors.fetch_articles(table(spark, sf_dir, ARTICLES).select("url").where("url is not null").distinct(), fetch).select("url", "title", "authors", "source_domain")


def article_query(spark, sf_dir):
    found = connectors.article_query(table(spark, sf_dir, ARTICLES), WORDS, EXCLUDED, AFTER, BEFORE, not_sites=["agerpres.ro/english/"])
    return found.select("url", "title").distinct()


def exportable_articles(spark, sf_dir):
    return io.exportable(table(spark, sf_dir, ARTICLES))


def export_counts(spark, sf_dir):
    """Valid, empty and invalid rows of an export."""
    counts = io.export_articles(table(spark, sf_dir, ARTICLES), _path(spark, "export"))
    return spark.createDataFrame([(counts["valid"], counts["empty"], counts["invalid"])], "valid bigint, empty bigint, invalid bigint")


def dedup_urls(spark, sf_dir):
    """The first scrape of each url."""
    rows = table(spark, sf_dir, ARTICLES).where("url is not null").select("url", "scraped_at", "source_domain")
    return io.keep_first(rows, ["url"], ["scraped_at", "source_domain"]).select("url", "scraped_at", "source_domain")


def merge_keep_first(spark, sf_dir):
    """Union of three tables with other columns, the first table's row winning."""
    frames = [table(spark, sf_dir, t).select("url", "title") for t in (TOPICS, NER, ARTICLES)]
    return io.merge_articles(frames).select("url", "title")


def duplicate_urls(spark, sf_dir):
    return io.duplicate_keys(table(spark, sf_dir, ARTICLES))


def parsed_dates(spark, sf_dir):
    """Publication dates read from text; what is no date becomes null."""
    a = table(spark, sf_dir, ARTICLES).where("url is not null")
    text = F.when(F.contains("url", F.lit("/amp")), "no date").otherwise(F.date_format("date_publish", "yyyy-MM-dd HH:mm:ss"))
    return a.select("url", F.try_to_timestamp(text).alias("published")).distinct()


def partitioned_parts(spark, sf_dir):
    """Articles written by part and read back: rows of each of the eight static parts."""
    path = _path(spark, "parts")
    io.write_parts(part_assignment(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count("*").alias("n"))


def clean_comma_letters(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.comma_letters)


def clean_symbols(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.strip_symbols)


def clean_blanks(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.collapse_blanks)


def clean_tags(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.strip_tags)


def clean_quotations(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.strip_quotations)


def clean_numbers(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.strip_numbers)


def clean_links_files(spark, sf_dir):
    return _cleaned(spark, sf_dir, lambda c: X.strip_files(X.strip_links(c)))


def _cleaned(spark, sf_dir, step):
    return spread(table(spark, sf_dir, "documents").where("text is not null")).select("doc_id", F.md5(step(F.col("text")).cast("binary")).alias("digest"))


def clean_links(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.strip_links)


def clean_files(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.strip_files)


def html_pages(spark, sf_dir):
    """The readable text of pages, made here of the documents' titles and texts."""
    d = table(spark, sf_dir, "documents").where("title is not null and text is not null")
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"[\p{Z}\p{C}]+", " ")), "&", "&amp;"), "<", "&lt;")
    page = F.concat(F.lit("<html><head><style>p {color: red}</style></head><body><h1>"), safe(F.col("title")), F.lit("</h1><!-- none --><p>"), safe(F.col("text")), F.lit("</p><script>if (1) {}</script></body></html>"))
    return d.select("doc_id", F.md5(X.html_text(page).cast("binary")).alias("digest"))


def query_file(spark, sf_dir):
    """The search expression through a file, read whole."""
    path = _path(spark, "query")
    spark.createDataFrame([("\n".join(WORDS),)], "value string").coalesce(1).write.text(path)
    whole = io.read_query(spark, path)
    return whole.select(F.explode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("word"))


def json_map(spark, sf_dir):
    """A normalization map through a JSON file, beside a missing and a broken one, which give nothing."""
    sources = table(spark, sf_dir, "known_source_bias").select(F.col("source_domain").alias("k"), "label").distinct()
    path, broken = _path(spark, "map"), _path(spark, "broken")
    sources.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "label")))).alias("value")).coalesce(1).write.text(path)
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.text(broken)
    return io.read_json_map(spark, path).unionByName(io.read_json_map(spark, _path(spark, "none"))).unionByName(io.read_json_map(spark, broken))


def batch_checkpoints(spark, sf_dir):
    """Names saved batch by batch, of which the latest value counts."""
    path = _path(spark, "batches")
    names = table(spark, sf_dir, NER).select(F.explode("ner").alias("raw")).where("raw is not null").distinct()
    kind = "raw string, canonical string"
    done = io.read_batches(spark, path, "raw", "canonical", kind)
    io.append_batch(names.join(done.select("raw"), "raw", "left_anti").select("raw", F.lower("raw").alias("canonical")), path, 1)
    io.append_batch(names.where(F.length("raw") % 2 == 0).select("raw", F.upper("raw").alias("canonical")), path, 2)
    return io.read_batches(spark, path, "raw", "canonical", kind)


def literal_lists(spark, sf_dir):
    """Lists that were written as Python literals, read back."""
    n = table(spark, sf_dir, NER).where("url is not null and ner is not null").select("url", "ner")
    quoted = F.transform("ner", lambda x: F.when(x.isNull(), "None").when(F.contains(x, F.lit("'")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), x, F.lit("'"))))
    text = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return n.select("url", F.concat_ws("|", X.parse_list(text)).alias("names"))


def literal_stances(spark, sf_dir):
    """Stances that were written as Python literals, among tuples of entities that were not found."""
    t = table(spark, sf_dir, TOPICS).where("url is not null and stance is not null").select("url", "stance")
    text = lambda x: F.when(x.isNull(), "None").otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("")), F.lit("'")))
    each = F.transform("stance", lambda s: F.concat(F.lit("{'entity': "), text(s.entity), F.lit(", 'stance': "), text(s.stance), F.lit("}")))
    literal = F.concat(F.lit("[('Nimeni', 'NO_ENTITY'), "), F.array_join(each, ", "), F.lit("]"))
    got = X.parse_stances(F.when(F.size("stance") > 0, literal).otherwise("[]"))
    return t.select("url", F.array_join(F.transform(got, lambda s: F.concat_ws("=", s.entity, s.stance)), "|").alias("stances"))


def tidy_names(spark, sf_dir):
    """Model tokens without punctuation around them and word-piece marks."""
    n = table(spark, sf_dir, NER).select(F.explode("ner").alias("name")).where("name is not null").distinct()
    return n.select("name", X.tidy_token(F.concat(F.lit('"##'), "name", F.lit('.)'))).alias("token"))


def source_slugs(spark, sf_dir):
    s = table(spark, sf_dir, ARTICLES).select(norm_source(F.col("source_domain")).alias("source")).where("source is not null").distinct()
    return s.select("source", X.url_slug(F.col("source")).alias("slug"))


#: Our own wording; the names in braces are filled in.
STANCE_PROMPT = "Ce atitudine are textul față de {entity}? Răspunde cu pozitiv, negativ sau neutru.\n{context}"


def stance_prompts(spark, sf_dir):
    """A prompt for each article and entity, with the text cut as a prompt takes it."""
    t = table(spark, sf_dir, TOPICS).where("url is not null and cleantext is not null").select("url", "cleantext", F.explode("ner").alias("entity")).where("entity is not null").distinct()
    return t.select("url", "entity", F.md5(X.prompt(STANCE_PROMPT, entity=F.col("entity"), context=X.truncate(F.col("cleantext"))).cast("binary")).alias("digest"))


def entity_mentions(spark, sf_dir):
    """Which names of an article stand in its text as whole words."""
    n = table(spark, sf_dir, NER).where("url is not null and cleantext is not null").select("url", "cleantext", F.explode("ner").alias("entity")).where("entity rlike '^[\\\\p{L}\\\\p{N}](.*[\\\\p{L}\\\\p{N}])?$'").distinct()
    return n.select("url", "entity", X.mentions(F.col("cleantext"), F.col("entity")).alias("mentioned"))


def trimmed_columns(spark, sf_dir):
    """Columns dropped where they are there, and ignored where not."""
    return table(spark, sf_dir, TOPICS).select("url", "topic", "topic_0").distinct().drop("topic_0", "no_such_column")


PATTERNS = ["Citește și", "Abonează-te la buletinul zilnic", "Toate drepturile asupra acestui material aparțin publicației", "Lasă un comentariu mai jos"]


def clean_articles(spark, sf_dir):
    """Every article cleaned for models, without boilerplate."""
    return _texts(spark, sf_dir).select("url", X.clean_nlp(F.col("maintext"), _patterns(spark)).alias("cleantext"))


def clean_plain_articles(spark, sf_dir):
    """Boilerplate, cedilla letters, tags, quotations, symbols and blanks, in the order of the full cleaning."""
    t = X.strip_tags(X.comma_letters(X.strip_boilerplate(F.col("maintext"), _patterns(spark))))
    return _texts(spark, sf_dir).select("url", F.md5(X.collapse_blanks(X.strip_symbols(X.strip_quotations(t))).cast("binary")).alias("digest"))


def _texts(spark, sf_dir):
    return spread(io.one_row(table(spark, sf_dir, ARTICLES).where("maintext is not null").select("url", "maintext")))


def _patterns(spark):
    """The dictionary through a file, as it is given."""
    with tempfile.NamedTemporaryFile("w", suffix=".txt", encoding="utf-8") as f:
        f.write("# boilerplate\n\n" + "\n".join(f"  {x} " for x in PATTERNS) + "\n")
        f.flush()
        return io.read_patterns(f.name)


def clean_articles_marked(spark, sf_dir):
    """Every article cleaned for the matrix, sentences joined by a barrier."""
    return _texts(spark, sf_dir).select("url", X.clean_ml(F.col("maintext"), _patterns(spark)).alias("cleantext"))


def weak_minus_gold(spark, sf_dir):
    """Labelled urls that are not gold (anti-join); gold are those whose hash begins with 0, one in 16."""
    labels = table(spark, sf_dir, "article_labels").where("url is not null").select("url", "snorkel_label").distinct()
    gold = _gold(spark, sf_dir)
    return labels.join(gold, "url", "left_anti")


def _gold(spark, sf_dir):
    labels = table(spark, sf_dir, "article_labels").where("url is not null and snorkel_label is not null")
    return labels.where(F.substring(F.md5(F.col("url").cast("binary")), 1, 1) == "0").groupBy("url").agg(F.max("snorkel_label").alias("gold"))


def gold_join_weak(spark, sf_dir):
    return table(spark, sf_dir, "article_labels").select("url", "snorkel_label").distinct().join(_gold(spark, sf_dir), "url")


def biased_source_articles(spark, sf_dir):
    """Articles of sources known as biased (semi-join on a small dimension)."""
    biased = table(spark, sf_dir, "known_source_bias").where("label = 'biased'").select(norm_source(F.col("source_domain")).alias("source"))
    return table(spark, sf_dir, ARTICLES).select("url", norm_source(F.col("source_domain")).alias("source")).distinct().join(biased, "source", "left_semi")


def known_bias_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "known_source_bias").select(norm_source(F.col("source_domain")).alias("source"), "label")
    a = table(spark, sf_dir, TOPICS).where("url is not null").select("url", norm_source(F.col("source_domain")).alias("source")).distinct()
    return a.join(known, "source", "left").select("url", "source", F.when(F.col("label") == "biased", 1).otherwise(0).alias("source_known_biased"))


def tables_union(spark, sf_dir):
    """Union of tables with other columns, by name."""
    return table(spark, sf_dir, ARTICLES).select("url", "title").unionByName(table(spark, sf_dir, "article_labels").select("url", "snorkel_label"), allowMissingColumns=True)


def remaining_entities(spark, sf_dir):
    """Distinct names not yet handled: all without those of the feature table."""
    names = table(spark, sf_dir, NER).select(F.explode("ner").alias("entity")).where("entity is not null").distinct()
    return names.join(table(spark, sf_dir, "entity_source_sentiment_features").select("entity"), "entity", "left_anti")


def part_assignment(spark, sf_dir):
    urls = table(spark, sf_dir, ARTICLES).select("url").where("url is not null").distinct()
    return G.assign_part(urls, "url")


def entity_batches(spark, sf_dir):
    names = table(spark, sf_dir, NER).select(F.explode("ner").alias("entity"))
    return G.batches(names, "entity").select("batch", F.size("items").cast("bigint").alias("n"), F.array_min("items").alias("first"), F.array_max("items").alias("last"))


def stratified_sample(spark, sf_dir):
    a = table(spark, sf_dir, ARTICLES).where("url is not null").groupBy("url").agg(F.max(norm_source(F.col("source_domain"))).alias("source"))
    return G.stratified_sample(a.where("source is not null"), "source", "url", 4)


def quantile_bins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").cast("double").alias("chars"))
    return G.quantile_bins(d, "chars").select("doc_id", F.col("chars_bin").cast("bigint").alias("bin"))


def template_sample(spark, sf_dir):
    """The annotation template: four articles a source and two a cell of bias-word and topic-entropy quartiles, one row a url, hundred by hash order, label ``abstain``."""
    from presslens.plans.articles import _articles, _features

    a = _articles(spark, sf_dir).select("url", "source")
    f = materialize(_features(spark, sf_dir).select("url", F.round("bias_word_ratio", 9).alias("bias_word_ratio"), F.round("topic_entropy", 9).alias("topic_entropy")).na.fill(0.0), "bins")
    binned = G.quantile_bins(G.quantile_bins(f, "bias_word_ratio"), "topic_entropy").withColumn("cell", F.concat_ws(":", "bias_word_ratio_bin", "topic_entropy_bin"))
    by_source = G.stratified_sample(a.where("source is not null"), "source", "url", 4).select("url")
    by_bin = G.stratified_sample(binned, "cell", "url", 2).select("url")
    return G.shuffle_rows(by_source.union(by_bin).distinct(), "url").limit(100).withColumn("label", F.lit("abstain"))


def split_train_eval(spark, sf_dir):
    labels = table(spark, sf_dir, "article_labels").where("url is not null and snorkel_label in ('biased', 'unbiased')").groupBy("url").agg(F.max("snorkel_label").alias("label"))
    return G.stratified_split(labels, "label", "url")


QUERIES = {
    f.__name__: f
    for f in (articles_csv, url_lines, deduped_lines, search_links, fetched_articles, article_query, exportable_articles, export_counts, dedup_urls, merge_keep_first, duplicate_urls, parsed_dates, partitioned_parts, clean_comma_letters, clean_symbols, clean_blanks, clean_tags, clean_quotations, clean_numbers, clean_links_files, clean_links, clean_files, clean_plain_articles, html_pages, query_file, json_map, batch_checkpoints, literal_lists, literal_stances, tidy_names, source_slugs, stance_prompts, entity_mentions, trimmed_columns, clean_articles, clean_articles_marked, weak_minus_gold, gold_join_weak, biased_source_articles, known_bias_lookup, tables_union, remaining_entities, part_assignment, entity_batches, stratified_sample, quantile_bins, template_sample, split_train_eval)
}
_SRC = r"nullif(regexp_replace(lower(trim(source_domain)), '^www\.', ''), '')"
_BLANK = r"(maintext IS NULL OR NOT regexp_matches(maintext, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]'))"
_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"
_A = f"FROM {ARTICLES}"
_GOLD = "(SELECT url, max(snorkel_label) AS gold FROM article_labels WHERE url IS NOT NULL AND snorkel_label IS NOT NULL AND md5(url)[1] = '0' GROUP BY url)"
_PARTS = f"SELECT url, CASE WHEN t // 8 = 0 THEN 8 ELSE least((rn - 1) // (t // 8) + 1, 8) END::INT AS part FROM (SELECT url, row_number() OVER (ORDER BY url) AS rn, count(*) OVER () AS t FROM (SELECT DISTINCT url {_A} WHERE url IS NOT NULL))"
_DOC = "SELECT doc_id, md5({}) AS digest FROM documents WHERE text IS NOT NULL"
_BYSRC = f"SELECT url, max({_SRC}) AS source {_A} WHERE url IS NOT NULL GROUP BY url"
ORACLES = {
    "articles_csv": f"SELECT {', '.join(io.FIELDS)} {_A}",
    "url_lines": f"SELECT url, 2 * count(*) AS n {_A} WHERE url IS NOT NULL GROUP BY url",
    "deduped_lines": f"SELECT DISTINCT url {_A} WHERE url IS NOT NULL",
    "search_links": "SELECT 'https://example.org/' || p || '/' || i AS link FROM range(4) AS a(p), range(7) AS b(i)",
    "fetched_articles": f"SELECT DISTINCT url, string_split(url, '/')[-1] AS title, 'A; B' AS authors, string_split(url, '/')[3] AS source_domain {_A} WHERE url IS NOT NULL AND NOT suffix(url, '/amp')",
    "article_query": f"SELECT DISTINCT url, title {_A} WHERE (" + " OR ".join(f"coalesce(regexp_matches({c}, '(?i){'|'.join(WORDS)}'), false)" for c in ("title", "url", "maintext")) + f") AND NOT coalesce(regexp_matches(url, '(?i){'|'.join(EXCLUDED)}|agerpres.ro/english/'), false) AND date_publish >= TIMESTAMP '2023-01-01' AND date_publish < TIMESTAMP '2026-01-01'",
    "exportable_articles": f"SELECT {', '.join(io.FIELDS)} {_A} WHERE url IS NOT NULL AND NOT {_BLANK}",
    "export_counts": f"SELECT count(*) FILTER (url IS NOT NULL AND NOT {_BLANK}) AS valid, count(*) FILTER (url IS NOT NULL AND {_BLANK}) AS empty, count(*) FILTER (url IS NULL) AS invalid {_A}",
    "dedup_urls": f"SELECT url, scraped_at, source_domain FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY scraped_at NULLS FIRST, source_domain NULLS FIRST) AS r {_A} WHERE url IS NOT NULL) WHERE r = 1",
    "merge_keep_first": f"SELECT url, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY i, title NULLS FIRST) AS r FROM (SELECT 0 AS i, url, title FROM {TOPICS} UNION ALL SELECT 1, url, title FROM {NER} UNION ALL SELECT 2, url, title {_A}) WHERE url IS NOT NULL) WHERE r = 1",
    "duplicate_urls": f"SELECT url, count(*) AS n {_A} WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1",
    "parsed_dates": f"SELECT DISTINCT url, CASE WHEN contains(url, '/amp') THEN NULL ELSE date_trunc('second', date_publish) END AS published {_A} WHERE url IS NOT NULL",
    "partitioned_parts": f"SELECT part::BIGINT AS part, count(*) AS n FROM ({_PARTS}) GROUP BY part",
    "clean_comma_letters": _DOC.format("translate(text, 'ţşŢŞ', 'țșȚȘ')"),
    "clean_symbols": _DOC.format(r"translate(text, '*•·@~^_`+=\|', '')"),
    "clean_blanks": _DOC.format(f"trim(regexp_replace(text, '{_WS}', ' ', 'g'))"),
    "clean_tags": _DOC.format("regexp_replace(text, '<.*?>', '', 'g')"),
    "clean_quotations": _DOC.format("""regexp_replace(text, '["''„”‘’«»]{1,10}[^"''„”‘’«»]{1,1000}?["''„”‘’«»]{1,10}', '', 'gs')"""),
    "weak_minus_gold": f"SELECT DISTINCT url, snorkel_label FROM article_labels WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM {_GOLD})",
    "gold_join_weak": f"SELECT DISTINCT url, snorkel_label, gold FROM article_labels JOIN {_GOLD} USING (url)",
    "biased_source_articles": f"SELECT DISTINCT url, {_SRC} AS source {_A} WHERE {_SRC} IN (SELECT {_SRC} FROM known_source_bias WHERE label = 'biased')",
    "known_bias_lookup": f"SELECT DISTINCT url, {_SRC} AS source, CASE WHEN {_SRC} IN (SELECT {_SRC} FROM known_source_bias WHERE label = 'biased') THEN 1 ELSE 0 END AS source_known_biased FROM {TOPICS} WHERE url IS NOT NULL",
    "tables_union": f"SELECT url, title, NULL::VARCHAR AS snorkel_label {_A} UNION ALL SELECT url, NULL, snorkel_label FROM article_labels",
    "remaining_entities": f"SELECT DISTINCT entity FROM (SELECT unnest(ner) AS entity FROM {NER}) WHERE entity IS NOT NULL AND entity NOT IN (SELECT entity FROM entity_source_sentiment_features WHERE entity IS NOT NULL)",
    "part_assignment": _PARTS,
    "entity_batches": f"SELECT (rn - 1) // 200 AS batch, count(*) AS n, min(entity) AS first, max(entity) AS last FROM (SELECT entity, row_number() OVER (ORDER BY entity) AS rn FROM (SELECT DISTINCT unnest(ner) AS entity FROM {NER}) WHERE entity IS NOT NULL) GROUP BY 1",
    "stratified_sample": f"SELECT url, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || url), url) AS r FROM ({_BYSRC}) WHERE source IS NOT NULL) WHERE r <= 4",
    "quantile_bins": "SELECT doc_id, (CASE WHEN c >= q[1] THEN 1 ELSE 0 END + CASE WHEN c >= q[2] THEN 1 ELSE 0 END + CASE WHEN c >= q[3] THEN 1 ELSE 0 END)::BIGINT AS bin FROM (SELECT doc_id, length(text)::DOUBLE AS c FROM documents WHERE text IS NOT NULL), (SELECT quantile_cont(length(text)::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM documents WHERE text IS NOT NULL)",
    "split_train_eval": f"SELECT url, label, ('0x' || md5('42:' || label || ':' || url)[1:8])::BIGINT < {int(0.1 * 2**32)} AS is_eval FROM (SELECT url, max(snorkel_label) AS label FROM article_labels WHERE url IS NOT NULL AND snorkel_label IN ('biased', 'unbiased') GROUP BY url)",
}

# Characters of words, and blanks, for an engine whose classes are ASCII only.
_W = r"\p{L}\p{N}\p{M}\p{Pc}\x{200c}\x{200d}"
_S = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}"
_LINKS = rf"regexp_replace(text, '(?i)(https?://[^{_S}]+|www\.[^{_S}]+)', '', 'g')"
_ONE_FILE = rf"(?i)^([^{_W}]*)[{_W}][^{_S}]*\.(?:{'|'.join(X.FILE_EXTENSIONS)})([^{_W}].*)?$"


def _files(text: str) -> str:
    """Word by word: from its first letter or digit to the last extension."""
    return rf"array_to_string(list_transform(regexp_extract_all({text}, '[{_S}]+|[^{_S}]+'), lambda x: regexp_replace(x, '{_ONE_FILE}', '\1\2', 's')), '')"


_BOILER = "maintext"
for _p in PATTERNS:
    _BOILER = f"regexp_replace({_BOILER}, '(?i){_p}', '', 'g')"
_QUOTED = "['" + X.QUOTES.replace("'", "''") + "']"
_QUOTED = _QUOTED.replace("['", "[").replace("']", "]")
_PLAIN = f"regexp_replace(regexp_replace(translate({_BOILER}, 'ţşŢŞ', 'țșȚȘ'), '<.*?>', '', 'g'), '{_QUOTED}{{1,10}}[^{_QUOTED[1:]}{{1,1000}}?{_QUOTED}{{1,10}}', '', 'gs')"
_SAFE = r"trim(regexp_replace({}, '[\p{{Z}}\p{{C}}]+', ' ', 'g'))"
_BEFORE_ENTITY, _, _AFTER_ENTITY = STANCE_PROMPT.partition("{entity}")
_AFTER_ENTITY = _AFTER_ENTITY.partition("\n")[0]
ORACLES |= {
    "clean_numbers": _DOC.format(rf"array_to_string(list_transform(regexp_extract_all(text, '[{_W}]+|[^{_W}]+'), lambda x: CASE WHEN regexp_full_match(x, '\p{{Nd}}+') AND NOT regexp_matches(x, '^20\p{{Nd}}\p{{Nd}}') THEN '' ELSE x END), '')"),
    "clean_links": _DOC.format(_LINKS),
    "clean_files": _DOC.format(_files("text")),
    "clean_links_files": _DOC.format(_files(_LINKS)),
    "clean_plain_articles": f"SELECT url, md5(trim(regexp_replace(translate({_PLAIN}, '*•·@~^_`+=\\|', ''), '{_WS}', ' ', 'g'))) AS digest FROM (SELECT url, max(maintext) AS maintext {_A} WHERE url IS NOT NULL AND maintext IS NOT NULL GROUP BY url)",
    "html_pages": f"SELECT doc_id, md5(trim({_SAFE.format('title')} || chr(10) || {_SAFE.format('text')}, ' ' || chr(10))) AS digest FROM documents WHERE title IS NOT NULL AND text IS NOT NULL",
    "query_file": "SELECT unnest([" + ", ".join(f"'{w}'" for w in WORDS) + "]) AS word",
    "json_map": "SELECT DISTINCT source_domain AS raw, label AS canonical FROM known_source_bias",
    "batch_checkpoints": f"SELECT raw, CASE WHEN length(raw) % 2 = 0 THEN upper(raw) ELSE lower(raw) END AS canonical FROM (SELECT DISTINCT unnest(ner) AS raw FROM {NER}) WHERE raw IS NOT NULL",
    "literal_lists": f"SELECT url, array_to_string(list_filter(ner, lambda x: x IS NOT NULL), '|') AS names FROM {NER} WHERE url IS NOT NULL AND ner IS NOT NULL",
    "literal_stances": f"SELECT url, coalesce(array_to_string(list_transform(list_filter(stance, lambda s: s.entity IS NOT NULL AND s.stance IS NOT NULL), lambda s: replace(s.entity, '''', '') || '=' || replace(s.stance, '''', '')), '|'), '') AS stances FROM {TOPICS} WHERE url IS NOT NULL AND stance IS NOT NULL",
    "tidy_names": f"SELECT name, replace(trim('\"##' || name || '.)', ' .,;:!?\"''()[]{{}}„”«»-'), '##', '') AS token FROM (SELECT DISTINCT unnest(ner) AS name FROM {NER}) WHERE name IS NOT NULL",
    "source_slugs": f"SELECT DISTINCT {_SRC} AS source, replace({_SRC}, '.', '_') AS slug {_A} WHERE {_SRC} IS NOT NULL",
    "stance_prompts": f"SELECT url, entity, md5('{_BEFORE_ENTITY}' || entity || '{_AFTER_ENTITY}' || chr(10) || replace(substring(cleantext, 1, 7800), chr(10), ' ')) AS digest FROM (SELECT DISTINCT url, cleantext, unnest(ner) AS entity FROM {TOPICS} WHERE url IS NOT NULL AND cleantext IS NOT NULL) WHERE entity IS NOT NULL",
    "entity_mentions": rf"SELECT url, entity, regexp_matches(cleantext, '(?is)(^|[^{_W}])' || regexp_escape(entity) || '($|[^{_W}])') AS mentioned FROM (SELECT DISTINCT url, cleantext, unnest(ner) AS entity FROM {NER} WHERE url IS NOT NULL AND cleantext IS NOT NULL) WHERE regexp_full_match(entity, '[\p{{L}}\p{{N}}](.*[\p{{L}}\p{{N}}])?')",
    "trimmed_columns": f"SELECT url, topic FROM (SELECT DISTINCT url, topic, topic_0 FROM {TOPICS})",
}

# The whole cleaning, step by step; entities other than these five do not occur in the tables.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": "\xa0", "&amp;": "&"}
_UNESCAPED = "t2"
for _x, _y in _ENTITIES.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '{_x}', '{_y}')"
_NUMBERS = rf"array_to_string(list_transform(regexp_extract_all(t4, '[{_W}]+|[^{_W}]+'), lambda x: CASE WHEN regexp_full_match(x, '\p{{Nd}}+') AND NOT regexp_matches(x, '^20\p{{Nd}}\p{{Nd}}') THEN '' ELSE x END), '')"
_CLEAN = f"""WITH s1 AS (SELECT url, regexp_replace(translate({_BOILER}, 'ţşŢŞ', 'țșȚȘ'), '<.*?>', '', 'g') AS text FROM (SELECT url, max(maintext) AS maintext {_A} WHERE url IS NOT NULL AND maintext IS NOT NULL GROUP BY url)),
s2 AS (SELECT url, {_files(_LINKS)} AS t2 FROM s1), s3 AS (SELECT url, {_UNESCAPED} AS t3 FROM s2),
s4 AS (SELECT url, regexp_replace(t3, '{_QUOTED}{{1,10}}[^{_QUOTED[1:]}{{1,1000}}?{_QUOTED}{{1,10}}', '', 'gs') AS t4 FROM s3),
s5 AS (SELECT url, trim(regexp_replace(translate({_NUMBERS}, '*•·@~^_`+=\\|', ''), '{_WS}', ' ', 'g')) AS cleantext FROM s4)"""
_MARKED = r"list_filter(list_transform(string_split(regexp_replace(cleantext, '([.!?…])[ \t\n\x{0b}\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
ORACLES |= {
    "clean_articles": _CLEAN + " SELECT url, cleantext FROM s5",
    "clean_articles_marked": _CLEAN + f" SELECT url, array_to_string(list_transform({_MARKED}, lambda x: lower(string_split(x, ' ')[1]) || substr(x, length(string_split(x, ' ')[1]) + 1)), ' PERIOD ') AS cleantext FROM s5",
}
