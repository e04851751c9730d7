"""The ordered user-agent pattern list and its JSON form.

List order is semantic: the first pattern (lowest ordinal) that occurs in a
text wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequence import number_rows
from .schemas import PATTERNS

# The reference pattern list, in its order, as
# (name, company, category). These must stay equal to the source for
# first-match results to agree.
DEFAULT_PATTERNS = (
    ("GPTBot", "OpenAI", "ai"),
    ("ChatGPT-User", "OpenAI", "ai"),
    ("OAI-SearchBot", "OpenAI", "ai"),
    ("ClaudeBot", "Anthropic", "ai"),
    ("Claude-Web", "Anthropic", "ai"),
    ("anthropic-ai", "Anthropic", "ai"),
    ("Google-Extended", "Google", "ai"),
    ("Google-CloudVertexBot", "Google", "ai"),
    ("Bard", "Google", "ai"),
    ("Gemini", "Google", "ai"),
    ("FacebookBot", "Meta", "ai"),
    ("Meta-ExternalAgent", "Meta", "ai"),
    ("Meta-ExternalFetcher", "Meta", "ai"),
    ("Applebot-Extended", "Apple", "ai"),
    ("Amazonbot", "Amazon", "ai"),
    ("PerplexityBot", "Perplexity", "ai"),
    ("cohere-ai", "Cohere", "ai"),
    ("CCBot", "CommonCrawl", "ai"),
    ("Diffbot", "Diffbot", "ai"),
    ("Bytespider", "ByteDance", "ai"),
    ("PetalBot", "Huawei", "ai"),
    ("DataForSeoBot", "DataForSeo", "ai"),
    ("ImagesiftBot", "Unknown", "ai"),
    ("omgili", "Webz.io", "ai"),
    ("omgilibot", "Webz.io", "ai"),
    ("AI2Bot", "AI2", "ai"),
    ("Scrapy", "generic", "generic"),
    ("python-requests", "generic", "generic"),
    ("python-urllib", "generic", "generic"),
    ("Go-http-client", "generic", "generic"),
    ("curl/", "generic", "generic"),
    ("Wget/", "generic", "generic"),
    ("libwww-perl", "generic", "generic"),
    ("HeadlessChrome", "generic", "generic"),
    ("Puppeteer", "generic", "generic"),
    ("Playwright", "generic", "generic"),
    ("PhantomJS", "generic", "generic"),
    ("Selenium", "generic", "generic"),
    ("SemrushBot", "Semrush", "generic"),
)

# Search bots the list allows; the match does not consult them.
ALLOWED_SEARCH_BOTS = ("Googlebot", "Bingbot", "DuckDuckBot", "Applebot")

# Defaults given to a newly added name.
DEFAULT_COMPANY = "unknown"
DEFAULT_CATEGORY = "ai"
MISSING_CATEGORY = "unknown"


def default_patterns(spark: SparkSession) -> DataFrame:
    """The default list as a DataFrame with ``ordinal`` 1..n."""
    rows = [(i + 1, n, c, k) for i, (n, c, k) in enumerate(DEFAULT_PATTERNS)]
    return spark.createDataFrame(rows, PATTERNS)


_ENTRY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("category", T.StringType()),
])
LIST_DOCUMENT = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("user_agents", T.ArrayType(_ENTRY)),
    T.StructField("allowed_search_bots", T.ArrayType(T.StringType())),
])


def read_pattern_list(spark: SparkSession, path: str) -> DataFrame:
    """Read list documents (JSON, one or many files, multi-line allowed) into
    (ordinal, name, company, category), numbered through all documents in the
    order of their paths; a missing category stays NULL and counts as
    ``unknown`` in statistics."""
    doc = spark.read.schema(LIST_DOCUMENT).option("multiLine", True).json(path)
    entries = doc.select(F.col("_metadata.file_path").alias("file"), F.posexplode("user_agents").alias("pos", "e"))
    return number_rows(entries, ["file", "pos"], out="ordinal").select(
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("e.name").alias("name"), F.col("e.company").alias("company"), F.col("e.category").alias("category"),
    )


def write_pattern_list(patterns: DataFrame, path: str) -> None:
    """Write the list back as one JSON document (ordered by ordinal). The list
    is a small control table; it is gathered into one task on purpose."""
    entries = F.sort_array(F.collect_list(F.struct("ordinal", "name", "company", "category")))
    (patterns.agg(entries.alias("e"))
     .select(F.lit("2.0.0").alias("version"), F.date_format(F.current_date(), "yyyy-MM-dd").alias("updated"),
             F.transform("e", lambda x: F.struct(x["name"].alias("name"), x["company"].alias("company"),
                                                 x["category"].alias("category"))).alias("user_agents"),
             F.array(*[F.lit(b) for b in ALLOWED_SEARCH_BOTS]).alias("allowed_search_bots"))
     .coalesce(1).write.mode("overwrite").json(path))
