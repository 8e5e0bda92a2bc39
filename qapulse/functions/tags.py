"""Technology domain of a delimited tag string ``<a><b>``."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains in order of precedence, with their exact, case-sensitive tags.
DOMAIN_TAGS = {
    "Legacy Stable": [
        "c++", "c#", ".net", "java", "sql", "oracle", "mysql",
        "postgresql", "sql-server", "vb.net", "delphi", "fortran",
        "cobol", "perl", "assembly", "matlab", "objective-c",
        "visual-studio", "wpf", "winforms", "spring", "hibernate",
    ],
    "Fast-Moving Web": [
        "javascript", "typescript", "react", "angular", "vue",
        "node.js", "next.js", "svelte", "webpack", "vite",
        "css", "html", "sass", "tailwind", "bootstrap",
        "express", "nestjs", "nuxt", "remix", "astro",
        "deno", "bun", "npm", "yarn", "pnpm",
    ],
    "AI / ML": [
        "python", "tensorflow", "pytorch", "keras",
        "scikit-learn", "pandas", "numpy", "matplotlib",
        "machine-learning", "deep-learning", "neural-network",
        "nlp", "computer-vision", "opencv", "transformers",
        "huggingface", "langchain", "openai", "gpt",
        "llm", "chatgpt", "stable-diffusion", "rag",
        "vector-database", "embeddings", "fine-tuning",
    ],
}
OTHER = "Other"


def tag_domain(tags: Column, groups: Mapping[str, Sequence[str]] = DOMAIN_TAGS) -> Column:
    """First domain with one of its tags present, else ``Other`` (also for NULL).

    One alternation per domain replaces a substring test per tag, so a row costs at most one regex
    scan per domain.
    """
    chain = F
    for domain, names in groups.items():
        any_tag = "<(?:" + "|".join(re.escape(name) for name in names) + ")>"
        chain = chain.when(tags.rlike(any_tag), domain)
    return chain.otherwise(OTHER)


def tag_count(tags: Column) -> Column:
    text = F.coalesce(tags, F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit("<"), F.lit("")))
