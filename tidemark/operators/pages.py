"""Pages: HTML to columns, links, and page intent."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import (any_of, best_scored, clamp, contains_any, count_contains, count_matches, first_match,
                                     keep, matches, words)
from tidemark.functions.urls import host, resolve
from tidemark.operators import ordered
from tidemark.session import once

SNIPPET_CHARS = 200  # fixed value
# entity, character (fixed values); &amp; last so that no entity is read twice
# fixed values: the named entities that prose holds; &amp; comes last, so that nothing is decoded twice
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"),
            ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
            ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&deg;", "°"),
            ("&euro;", "€"), ("&pound;", "£"), ("&sect;", "§"), ("&times;", "×"), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def snippet(text: Column, length: int = SNIPPET_CHARS) -> Column:
    """At most ``length`` characters (not bytes), with dots when something was cut."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def sanitise_text(text: Column) -> Column:
    """P19."""
    return F.trim(F.translate(text, "<>\"';", ""))


def html_to_page(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Title, meta description and body text of raw HTML, by native expressions on the whole page.

    The text runs from <body> to </body> or, where that is missing, to the end; a page without <body> is text as a whole
    but for its title. ``max_chars`` cuts the text the way a crawler with a size limit would; by default nothing is cut.
    """
    html = F.col("html")
    inside = F.regexp_replace(F.regexp_replace(html, r"(?is)^.*?<body(?:\s[^>]*)?>", ""), r"(?is)</body>.*$", "")
    body = F.when(F.rlike(html, F.lit(r"(?i)<body(?:\s[^>]*)?>")), inside).otherwise(F.regexp_replace(html, r"(?is)<title[^>]*>.*?</title>", ""))
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"<[^>]+>", "")
    content = F.trim(F.replace(unescape(bare), F.lit("\n"), F.lit(" ")))
    return pages.select(
        "page_id", "url", unescape(title_of(html)).alias("title"), (content if max_chars is None else F.left(content, F.lit(max_chars))).alias("content"),
        unescape(F.regexp_extract(html, r'(?is)<meta\s+name="description"\s+content="([^"]*)"', 1)).alias("meta_description"),
        F.length(html).cast("bigint").alias("content_length"))


def html_to_page_parsed(pages: DataFrame) -> DataFrame:
    """D1, accurate path: the standard library's HTML parser inside Arrow batches. It knows every entity
    and keeps text inside scripts whole; use it where the native path is not enough."""

    def parse(batches: Iterator) -> Iterator:
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.title, self.meta, self.body, self.where, self.done = [], "", [], "", False

            def handle_starttag(self, tag, attrs):
                if tag == "title" and not self.done:
                    self.where = "title"
                elif tag == "body":
                    self.where = "body"
                elif tag == "meta":
                    d = dict(attrs)
                    if (d.get("name") or "").lower() == "description":
                        self.meta = d.get("content") or ""

            def handle_endtag(self, tag):
                if tag == "title" and self.where == "title":
                    self.where, self.done = "", True
                elif tag == "body":
                    self.where = ""

            def handle_data(self, data):
                if self.where == "title":
                    self.title.append(data)
                elif self.where == "body":
                    self.body.append(data)

        for pdf in batches:
            out = []
            for html in pdf["html"]:
                r = Reader()
                r.feed(html or "")
                r.close()
                out.append(("".join(r.title), "".join(r.body).replace("\n", " ").strip(), r.meta))
            pdf["title"], pdf["content"], pdf["meta_description"] = zip(*out) if out else ([], [], [])
            yield pdf[["page_id", "url", "title", "content", "meta_description"]]

    return pages.select("page_id", "url", "html").mapInPandas(
        parse, "page_id bigint, url string, title string, content string, meta_description string")


def crawlable(host_: Column, lower: Column) -> Column:
    """P12, crawler variant: no blocked host, no media, asset or login word anywhere in the lower-cased URL."""
    return ~contains_any(host_, vocab.CRAWL_BLOCKED_DOMAINS) & ~contains_any(lower, vocab.CRAWL_SKIP_PATTERNS)


def crawlable_urls(urls: DataFrame, url: str) -> DataFrame:
    """Rows whose URL may be crawled; host and lower-case form are found once, not for each word that is looked for."""
    staged = once(urls, _host=F.coalesce(host(F.col(url)), F.lit("")), _low=F.lower(url))
    return staged.where(crawlable(F.col("_host"), F.col("_low"))).drop("_low")


def crawlable_seed(url: Column) -> Column:
    """P12, seed variant: no skip word, no skipped file type at the end."""
    u = F.lower(url)  # one common expression of a projection; a filter needs it as a column
    return ~contains_any(u, vocab.SEED_SKIP_WORDS) & ~any_of(u.endswith(e) for e in vocab.SEED_SKIP_EXTENSIONS)


def known_domain(url: Column) -> Column:
    """P12, known-domain skip."""
    return contains_any(url, vocab.KNOWN_DOMAINS)


def extract_links(pages: DataFrame) -> DataFrame:
    """Crawlable links of each page, resolved against the page, with their anchor text."""
    pattern = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""
    seen = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), r"(?is)<script[^>]*>.*?</script>", "")
    # the page is searched once; the groups are then read from each link
    found = pages.select("page_id", "url", F.explode(F.regexp_extract_all(seen, F.lit(pattern), F.lit(0))).alias("a"))
    quoted, single, bare, anchor = (F.regexp_extract("a", pattern, i) for i in (1, 2, 3, 4))
    both = F.struct(F.concat(quoted, single, bare).alias("href"), anchor.alias("anchor"))  # two of the three are empty
    links = found.select("page_id", "url", both.alias("l")).select(
        F.col("page_id").alias("source_page_id"), F.col("url").alias("source_url"),
        resolve(F.col("url"), unescape(F.col("l.href"))).alias("target_url"),
        F.trim(unescape(F.regexp_replace("l.anchor", r"<[^>]+>", ""))).alias("anchor_text"))
    return crawlable_urls(links, "target_url").where(F.col("_host") != "").drop("_host").select("*", F.lit("dofollow").alias("link_type"))


# ---------------------------------------------------------------- page intent
def analysis_text(title: Column, content: Column, meta: Column, max_chars: int | None = None) -> Column:
    """Title, content and description, blanks left out. The whole content is read unless
    ``max_chars`` asks for a cut."""
    body = content if max_chars is None else F.left(content, F.lit(max_chars))
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")), F.nullif(meta, F.lit("")))


def _hit(text: Column, pattern: str) -> Column:
    return matches(text, pattern, unicode=False)


def _tally(text: Column, patterns: list[tuple[str, str]], order: list[str], default: str) -> Column:
    def score(label: str) -> Column:
        total = F.lit(0)
        for p, v in patterns:
            if v == label:
                total = total + _hit(text, p).cast("int")
        return total

    return best_scored([(label, score(label)) for label in order], default)


def page_goal(lower: Column) -> Column:
    """D3: goal with the most matching patterns; ties go to the goal declared first."""
    return _tally(lower, vocab.PAGE_GOAL_PATTERNS, vocab.PAGE_GOAL_ORDER, "learn")


def page_use_cases(lower: Column) -> Column:
    """D4."""
    found = keep([(F.lit(v), _hit(lower, p)) for p, v in vocab.PAGE_USE_CASE_PATTERNS])
    return F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit("learning")))


def page_complexity(lower: Column) -> Column:
    """D5."""
    return _tally(lower, vocab.PAGE_COMPLEXITY_PATTERNS, [v for _, v in vocab.PAGE_COMPLEXITY_PATTERNS], "moderate")


def page_result_type(lower: Column) -> Column:
    """D6."""
    return _tally(lower, vocab.PAGE_RESULT_TYPE_PATTERNS, [v for _, v in vocab.PAGE_RESULT_TYPE_PATTERNS], "tutorial")


def page_ethical_signals(lower: Column) -> Column:
    """D7."""
    return keep([(F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("preference")), _hit(lower, p))
                 for p, d, v in vocab.PAGE_ETHICAL_PATTERNS])


def page_skill_level(lower: Column) -> Column:
    """D8."""
    beginner = count_matches(lower, [vocab.PAGE_BEGINNER_PATTERN], unicode=False)
    advanced = count_matches(lower, [vocab.PAGE_ADVANCED_PATTERN], unicode=False)
    return F.when(advanced > beginner, "advanced").when(beginner > 0, "beginner").otherwise("intermediate")


def topic_words(text: Column) -> Column:
    """Words longer than four bytes, trimmed of punctuation, without stop words."""
    trimmed = F.transform(words(text), lambda w: F.btrim(F.lower(w), F.lit(vocab.PAGE_TRIM_CHARS)))
    return F.filter(trimmed, lambda w: (F.octet_length(w) > 4) & ~w.isin(vocab.PAGE_STOP_WORDS))


def topic_counts(docs: DataFrame, key: str, topics: Column, k: int) -> DataFrame:
    """The k most frequent entries of an array column per key. Counts are aggregated before they are
    ranked."""
    counts = docs.select(key, F.explode(topics).alias("topic")).groupBy(key, "topic").agg(
        F.count(F.lit(1)).alias("count"))
    return ordered.top_k(counts, [key], [F.col("count").desc(), F.col("topic")], k)


def page_topics(docs: DataFrame, k: int = 10) -> DataFrame:
    """Ten most frequent topic words of each page, from its ``text`` column."""
    return topic_counts(docs, "page_id", topic_words(F.col("text")), k)


def key_phrases(lower: Column) -> Column:
    """D10."""
    return keep([(F.lit(p), lower.contains(p)) for p in vocab.KEY_PHRASES])


def extraction_confidence(use_cases: Column, signals: Column, goal: Column, n_topics: Column) -> Column:
    """D11."""
    total = (F.lit(0.5) + F.when(F.size(use_cases) > 0, 0.1).otherwise(0.0) + F.when(F.size(signals) > 0, 0.1).otherwise(0.0)
             + F.when(goal.isNotNull(), 0.1).otherwise(0.0) + F.when(n_topics > 5, 0.1).otherwise(0.0))
    return F.least(total, F.lit(0.95))


def ascii_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0), lambda w: F.lower(w))


def analyse_pages(docs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """D3-D11, D14 of pages with title, content and meta_description (and pagerank, if there is one)."""
    rank = F.col("pagerank") if "pagerank" in docs.columns else F.lit(0.0)
    # each pattern reads the same columns, and a filter on a tag must not bring the page's parsing back once per pattern
    staged = once(docs, text=analysis_text(F.col("title"), F.col("content"), F.col("meta_description"), max_chars))
    lower = F.col("_lower")
    staged = once(once(staged, _lower=F.lower("text")), primary_goal=page_goal(lower), use_cases=page_use_cases(lower))
    tagged = staged.select(
        *docs.columns, "text", "primary_goal", "use_cases",
        page_complexity(lower).alias("complexity"), page_result_type(lower).alias("result_type"),
        page_ethical_signals(lower).alias("ethical_signals"), page_skill_level(lower).alias("skill_level"),
        key_phrases(lower).alias("key_phrases"),
        F.size(F.array_distinct(topic_words(F.col("text")))).alias("n_topics"),
        F.size(ascii_words(F.col("content"))).cast("bigint").alias("word_count"))
    scored = tagged.withColumn("confidence", extraction_confidence(
        F.col("use_cases"), F.col("ethical_signals"), F.col("primary_goal"), F.least(F.col("n_topics"), F.lit(10))))
    return scored.withColumn("quality_score", quality_score(
        F.col("word_count"), F.col("confidence"), rank, F.size("ethical_signals")))


def quality_score(word_count: Column, confidence: Column, pagerank: Column, n_signals: Column) -> Column:
    """D14."""
    length = F.when(word_count > 1000, 0.15).when(word_count > 500, 0.10).when(word_count > 200, 0.05).otherwise(0.0)
    sure = F.when(confidence > 0.8, 0.15).when(confidence > 0.6, 0.10).when(confidence > 0.4, 0.05).otherwise(0.0)
    ranked = F.when(pagerank > 0.7, 0.10).when(pagerank > 0.4, 0.05).otherwise(0.0)
    return F.least(F.lit(0.5) + length + sure + ranked + F.when(n_signals > 0, 0.05).otherwise(0.0), F.lit(1.0))


def term_frequencies(docs: DataFrame, key: str = "page_id", content: str = "content") -> DataFrame:
    """(key, term, tf) of terms longer than two letters."""
    return (docs.select(key, F.explode(ascii_words(F.col(content))).alias("term")).where(F.length("term") > 2)
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))


# ---------------------------------------------------------------- web page intent
def web_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def web_terms(lower: Column) -> Column:
    """Words of three or more ASCII letters that stand alone, without stop words."""
    parts = F.split(lower, r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(vocab.WEB_STOP_WORDS))


def web_page_intent(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Intent of raw web pages by keyword counts."""
    staged = pages.select("page_id", "url", "html", web_text(F.col("html")).alias("text"))
    body = F.col("text") if max_chars is None else F.left("text", F.lit(max_chars))
    staged = staged.withColumn("lower", F.lower(body))
    low = F.col("lower")
    scores = [(g, count_contains(low, ws)) for g, ws in vocab.WEB_GOAL_WORDS]
    goal = F.when(F.greatest(*[s for _, s in scores]) >= 2, best_scored(scores, "find_information")).otherwise("find_information")
    cases = keep([(F.lit(u), contains_any(low, ws)) for u, ws in vocab.WEB_USE_CASE_WORDS])
    cases = F.when(F.size(cases) > 0, cases).otherwise(F.array(F.lit("learning")))
    n_words, sentences = F.size(words(F.col("text"))), F.regexp_count("text", F.lit(r"[.!?]+"))
    average = F.when(sentences > 0, n_words / sentences).otherwise(n_words.cast("double"))
    complexity = (F.when((n_words < 500) | (average < 10), "simple").when((n_words > 2000) | (average > 25), "advanced")
                  .otherwise("moderate"))
    beginner, advanced = count_contains(low, vocab.WEB_BEGINNER_WORDS), count_contains(low, vocab.WEB_ADVANCED_WORDS)
    skill = F.when(advanced > beginner, "advanced").when(beginner > 0, "beginner").otherwise("intermediate")
    tagged = staged.select(
        "page_id", "url", F.trim(title_of(F.col("html"))).alias("title"), F.left("text", F.lit(SNIPPET_CHARS)).alias("description"),
        goal.alias("primary_goal"), cases.alias("use_cases"),
        first_match([(r, contains_any(low, ws)) for r, ws in vocab.WEB_RESULT_TYPE_WORDS], "answer").alias("result_type"),
        complexity.alias("complexity"), skill.alias("skill_level"), web_terms(low).alias("terms"))
    n_cases = F.size("use_cases")
    confidence = (F.lit(0.5) + F.when(F.col("primary_goal") != "find_information", 0.15).otherwise(0.0)
                  + F.when(n_cases > 1, F.lit(0.1) * F.least(n_cases, F.lit(3))).otherwise(0.0)
                  + F.when(F.size(F.array_distinct("terms")) >= 3, 0.1).otherwise(0.0))
    return tagged.withColumn("confidence", clamp(confidence))


def web_topics(tagged: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent terms of each page."""
    return topic_counts(tagged, "page_id", F.col("terms"), k)


def simple_tags(docs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Goal and topics by one pass of keyword tests."""
    body = F.col("content") if max_chars is None else F.left("content", F.lit(max_chars))
    t = F.lower(F.concat_ws(" ", "title", body))
    return docs.select("page_id", first_match([(g, contains_any(t, ws)) for g, ws in vocab.TAG_GOAL_WORDS], "learn").alias("goal"),
                       keep([(F.lit(w), t.contains(w)) for w in vocab.TAG_TOPICS]).alias("topics"))
