"""Ordered keyword rule tables (D7) and their compilation to Spark columns.

Matching is substring matching on lower-cased text and the first rule in
list order wins.  A rule table is small and fixed, so it compiles to one
``CASE``/``OR`` expression that stays inside whole-stage codegen; no UDF and
no join is needed.  ``rule_frame`` exposes the same tables as DataFrames for
users who keep rules as data.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: these lists must equal the tracker's for equal results.
# They are kept in the tracker's order, since the first match wins.
# ---------------------------------------------------------------------------

# Header aliases per task field, in field order then alias order.
HEADER_ALIASES: list[tuple[str, list[str]]] = [
    ("name", ["problem", "task", "name", "title", "question", "work", "activity", "item",
              "problem name", "task name", "question name", "dsa task", "dsa task 1",
              "dsa task 2", "dsa task 3", "exercise", "subtopic", "problem title"]),
    ("topic", ["topic", "subject", "chapter", "area", "concept", "tag", "category name"]),
    ("category", ["category", "cat", "type", "section", "domain"]),
    ("difficulty", ["difficulty", "level", "hard", "easy", "medium", "diff", "priority"]),
    ("problem_link", ["link", "url", "problem link", "leetcode", "gfg", "solution", "problem url",
                      "lc link", "lc", "question link", "coding link", "practice link", "solve link",
                      "problem_link", "leetcode link", "leetcode url", "lc url", "question url",
                      "hackerrank", "codechef", "codeforces", "interviewbit", "coding url", "prob link",
                      "prob url", "ques link", "ques url"]),
    ("resource_link", ["resource", "resource link", "reference", "ref", "article", "video", "youtube",
                       "notes link", "resource url", "tutorial", "study link", "explanation",
                       "resource_link", "notes", "material", "study material"]),
    ("date", ["date", "due", "deadline", "scheduled", "day", "due date", "schedule date",
              "planned date", "day no", "day number"]),
    ("platform", ["platform", "site", "source", "website"]),
]

# Topic-list layout (N4): header sets; the first column in sheet order wins.
TOPIC_LIST_TOPIC_HEADERS = ["topic", "subject"]
TOPIC_LIST_LINK_HEADERS = ["resource", "resource link", "ref", "link", "url"]
TOPIC_LIST_PRIORITY_HEADERS = ["priority", "difficulty", "level", "status"]

# Sheet-name category keys (N7), in order.
SHEET_CATEGORY_RULES: list[tuple[str, str]] = [
    ("dsa", "DSA"), ("leetcode", "DSA"), ("coding", "DSA"), ("data structure", "DSA"),
    ("algorithm", "DSA"), ("algo", "DSA"),
    ("apti", "Aptitude"), ("aptitude", "Aptitude"), ("quant", "Aptitude"), ("math", "Aptitude"),
    ("verbal", "Verbal"), ("english", "Verbal"), ("communication", "Verbal"),
    ("interview", "Interview"), ("hr", "HR"), ("behavioral", "HR"),
    ("sql", "Interview"), ("dbms", "Interview"), ("database", "Interview"),
    ("oops", "Interview"), ("oop", "Interview"), ("object", "Interview"),
    ("network", "Interview"), ("cn", "Interview"),
    ("linux", "Interview"), ("os", "Interview"), ("operating", "Interview"),
    ("system_design", "Interview"), ("system design", "Interview"), ("roadmap", "Interview"),
]
# Header-based fallback of N7, tried per header in column order.
HEADER_CATEGORY_RULES: list[tuple[list[str], str]] = [
    (["aptitude", "indiabix"], "Aptitude"),
    (["verbal", "hr"], "Verbal"),
]
DEFAULT_CATEGORY = "DSA"

# Day-grid layout (N5): category by the column header, then N7 on the header.
DAY_GRID_HEADER_RULES: list[tuple[list[str], str]] = [
    (["dsa"], "DSA"),
    (["apti"], "Aptitude"),
    (["verbal", "hr"], "Verbal"),
    (["interview", "system", "oops", "sql", "network", "linux"], "Interview"),
]

# Platform by link (N8), in order; no match or blank link -> Custom.
PLATFORM_RULES: list[tuple[list[str], str]] = [
    (["leetcode"], "LeetCode"),
    (["geeksforgeeks", "gfg"], "GFG"),
    (["hackerrank"], "HackerRank"),
    (["indiabix"], "IndiaBix"),
    (["youtube", "youtu.be"], "YouTube"),
    (["codechef"], "CodeChef"),
    (["codeforces"], "Codeforces"),
    (["neetcode"], "NeetCode"),
    (["interviewbit"], "InterviewBit"),
    (["w3schools"], "W3Schools"),
    (["visualgo"], "VisuAlgo"),
]
DEFAULT_PLATFORM = "Custom"

# Blank markers after trim and lower-casing.
BLANK_VALUES = ["", "nan", "none"]

# Difficulty words.
LAYOUT_A_DIFFICULTY_KEEP = ["easy", "medium", "hard"]
HIGH_PRIORITY_WORDS = ["must", "high", "critical"]
LOW_PRIORITY_WORDS = ["optional", "low"]

# News relevance keywords.
RELEVANCE_KEYWORDS = [
    "placement", "interview", "hiring", "internship", "job", "career", "campus",
    "ai", "artificial intelligence", "machine learning", "deep learning", "llm", "gpt",
    "python", "javascript", "rust", "go lang", "programming", "software", "developer",
    "data science", "algorithm", "coding", "leetcode", "tech", "startup", "layoff",
    "cloud", "open source", "github", "framework", "api", "neural", "model",
    "gpu", "chip", "quantum", "security", "blockchain", "database", "devops",
]

# News topic tags (T2), in order; default Tech.
TAG_RULES: list[tuple[list[str], str]] = [
    (["ai", "llm", "gpt", "claude", "gemini", "neural", "model", "deep learning",
      "machine learning", "data science", "hugging face"], "AI/ML"),
    (["placement", "interview", "hiring", "campus", "internship", "job offer", "salary",
      "package"], "Career"),
    (["javascript", "typescript", "react", "vue", "node", "frontend", "css", "html", "web"], "Web Dev"),
    (["python", "rust", "go", "java", "kotlin", "swift", "c++", "programming", "compiler"], "Languages"),
    (["cloud", "aws", "azure", "gcp", "kubernetes", "docker", "devops", "infra", "server"],
     "Cloud/DevOps"),
    (["security", "hack", "vulnerability", "breach", "crypto", "encryption"], "Security"),
    (["startup", "funding", "ipo", "acquisition", "layoff"], "Industry"),
    (["chip", "gpu", "nvidia", "intel", "amd", "hardware", "quantum", "semiconductor"], "Hardware"),
    (["open source", "github", "git", "linux", "android", "ios"], "Open Source"),
]
DEFAULT_TAG = "Tech"

# Personal-intent phrases (T5).
PERSONAL_SIGNALS = [
    "my progress", "my plan", "my data", "my status", "my streak", "my score",
    "my weak", "my strong", "my performance", "my problems", "my solved",
    "how am i", "how i am", "how many have i", "am i ready", "am i on track",
    "what should i", "what do i", "what have i", "where am i",
    "today's plan", "today's task", "today's focus", "my today",
    "my readiness", "my deadline", "my goal", "my target", "my pace",
    "give me my", "show me my", "tell me my", "update me", "status report",
    "placement readiness", "how ready", "daily briefing", "my schedule",
    "i have solved", "i solved", "i skipped", "i attempted",
    "my category", "my topic", "my algorithm", "my course", "my project",
]

# Resource-intent keywords.
RESOURCE_KEYWORDS = ["resource", "tutorial", "video", "article", "practice", "learn",
                     "how to", "study", "material", "give me", "explain", "teach",
                     "where to", "link", "reference", "website", "site"]

# Fallback resource links by topic key (T7), in order; first key contained wins.
FALLBACK_RESOURCES: list[tuple[str, list[str]]] = [
    ("array", ["https://takeuforward.org/arrays/", "https://www.geeksforgeeks.org/array-data-structure/",
               "https://leetcode.com/tag/array/"]),
    ("binary search", ["https://takeuforward.org/binary-search/", "https://www.geeksforgeeks.org/binary-search/",
                       "https://leetcode.com/tag/binary-search/"]),
    ("dp", ["https://takeuforward.org/dynamic-programming/", "https://www.geeksforgeeks.org/dynamic-programming/",
            "https://leetcode.com/tag/dynamic-programming/"]),
    ("dynamic programming", ["https://takeuforward.org/dynamic-programming/",
                             "https://www.geeksforgeeks.org/dynamic-programming/",
                             "https://leetcode.com/tag/dynamic-programming/"]),
    ("graph", ["https://takeuforward.org/graph/", "https://www.geeksforgeeks.org/graph-data-structure/",
               "https://leetcode.com/tag/graph/"]),
    ("sql", ["https://www.geeksforgeeks.org/sql-tutorial/", "https://leetcode.com/studyplan/sql-50/",
             "https://www.w3schools.com/sql/"]),
    ("oops", ["https://www.geeksforgeeks.org/object-oriented-programming-oops-concept-in-java/",
              "https://takeuforward.org/oops/", "https://www.youtube.com/watch?v=BSVKUk48Kqc"]),
    ("two pointers", ["https://leetcode.com/tag/two-pointers/", "https://takeuforward.org/",
                      "https://www.geeksforgeeks.org/two-pointers-technique/"]),
    ("sliding window", ["https://leetcode.com/tag/sliding-window/",
                        "https://www.geeksforgeeks.org/window-sliding-technique/", "https://takeuforward.org/"]),
    ("stack", ["https://leetcode.com/tag/stack/", "https://www.geeksforgeeks.org/stack-data-structure/",
               "https://takeuforward.org/"]),
    ("tree", ["https://leetcode.com/tag/tree/", "https://www.geeksforgeeks.org/binary-tree-data-structure/",
              "https://takeuforward.org/"]),
    ("sorting", ["https://www.geeksforgeeks.org/sorting-algorithms/", "https://leetcode.com/tag/sorting/",
                 "https://visualgo.net/en/sorting"]),
    ("aptitude", ["https://www.indiabix.com/", "https://www.geeksforgeeks.org/aptitude-questions-and-answers/",
                  "https://www.freshersworld.com/aptitude"]),
    ("linked list", ["https://leetcode.com/tag/linked-list/",
                     "https://www.geeksforgeeks.org/data-structures/linked-list/", "https://takeuforward.org/"]),
    ("heap", ["https://leetcode.com/tag/heap-priority-queue/", "https://www.geeksforgeeks.org/heap-data-structure/",
              "https://takeuforward.org/"]),
    ("backtracking", ["https://leetcode.com/tag/backtracking/",
                      "https://www.geeksforgeeks.org/backtracking-algorithms/", "https://takeuforward.org/"]),
]
# Generated search links when no key matches; "{q}" is the topic with '+' for spaces.
SEARCH_LINK_TEMPLATES = [
    "https://www.geeksforgeeks.org/search/?q={q}",
    "https://leetcode.com/search/?q={q}",
    "https://www.youtube.com/results?search_query={q}+tutorial",
]
# Hosts accepted from a live search result (T7 whitelist).
RESOURCE_HOSTS = ["youtube.com", "youtu.be", "geeksforgeeks.org", "takeuforward.org", "neetcode.io",
                  "leetcode.com"]

# Router (T8): first matching rule wins, else "default".
ROUTER_RULES: list[tuple[list[str], str]] = [
    (["news"], "news"),
    (["weekly", "week"], "weekly"),
    (["daily", "today"], "daily"),
    (["suggest", "what should", "plan"], "suggest"),
]
DEFAULT_ROUTE = "default"

# Setting defaults given at signup.
SETTING_DEFAULTS = {
    "name": "Student",
    "daily_goal": "10",
    "placement_deadline": "2026-10-01",
}

# Articles used when no feed item survives (T3), in order.
FALLBACK_ARTICLES = [
    ("Top 10 Coding Interview Questions for 2026 Placements",
     "https://www.geeksforgeeks.org/top-10-algorithms-in-interview-questions/", "GeeksForGeeks", "Career", 100),
    ("How to Crack TCS NQT 2026 – Complete Preparation Guide",
     "https://www.geeksforgeeks.org/tcs-nqt-interview-preparation/", "GeeksForGeeks", "Career", 95),
    ("DSA Roadmap for Placement – Must-Do Topics",
     "https://takeuforward.org/interviews/strivers-sde-sheet-top-coding-interview-problems/", "TakeUForward",
     "Career", 90),
    ("Google launches Gemini 2.5 – What it means for developers", "https://blog.google/technology/ai/",
     "Google Blog", "AI/ML", 88),
    ("Python 3.13 Released – New Features Every Dev Should Know", "https://www.python.org/downloads/",
     "Python.org", "Languages", 80),
    ("Top 50 SQL Interview Questions for Freshers 2026", "https://www.interviewbit.com/sql-interview-questions/",
     "InterviewBit", "Career", 78),
    ("System Design Basics Every CS Student Must Know", "https://www.geeksforgeeks.org/system-design-tutorial/",
     "GeeksForGeeks", "Career", 75),
    ("Open Source AI Tools Reshaping the Job Market in 2026", "https://github.com/trending", "GitHub",
     "Open Source", 70),
    ("Infosys, Wipro & TCS Hiring Trends for 2026 Batch", "https://www.geeksforgeeks.org/companies-placement/",
     "GeeksForGeeks", "Career", 68),
]

# ---------------------------------------------------------------------------
# Compilation
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _word_regex(keywords: Iterable[str]) -> str:
    """Keywords as whole words: not preceded or followed by a letter or digit."""
    alts = "|".join(r"\Q" + k + r"\E" for k in keywords)
    return rf"(?<![\p{{L}}\p{{N}}])(?:{alts})(?![\p{{L}}\p{{N}}])"


def contains_any(text, keywords: Iterable[str], lowered: bool = False, whole_word: bool = False) -> Column:
    """True when the lower-cased text contains any keyword (OR of ``contains``;
    each is a JVM ``indexOf`` inside codegen and the chain short-circuits).
    ``whole_word=True`` (Q16 option) matches whole words only, so "ai" no
    longer hits "train"; it compiles to one regex per rule."""
    t = _c(text) if lowered else F.lower(_c(text))
    keywords = list(keywords)
    if whole_word:
        return t.rlike(_word_regex(keywords)) if keywords else F.lit(False)
    cond = None
    for k in keywords:
        e = t.contains(F.lit(k))
        cond = e if cond is None else (cond | e)
    return cond if cond is not None else F.lit(False)


def first_label(text, rules: Sequence[tuple[Sequence[str], str]], default, lowered: bool = False,
                whole_word: bool = False) -> Column:
    """Label of the first rule whose keywords occur in the text, else ``default``."""
    t = _c(text) if lowered else F.lower(_c(text))
    out = None
    for keys, label in rules:
        cond = contains_any(t, keys, lowered=True, whole_word=whole_word)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def sheet_category(sheet_name, whole_word: bool = False) -> Column:
    """N7 sheet-name part: label of the first key the name contains, NULL if none."""
    t = F.lower(_c(sheet_name))
    out = None
    for key, label in SHEET_CATEGORY_RULES:
        cond = t.rlike(_word_regex([key])) if whole_word else t.contains(F.lit(key))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def rule_frame(spark: SparkSession, rules: Sequence[tuple[Sequence[str], str]], name: str) -> DataFrame:
    """A rule table as rows ``(rule_set, rank, keyword, label)``."""
    rows = [(name, i, k, label) for i, (keys, label) in enumerate(rules) for k in keys]
    return spark.createDataFrame(rows, "rule_set string, rank int, keyword string, label string")
