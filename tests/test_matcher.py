"""The one-pass matcher against searching every pattern, and what each rule of the bundled taxonomy takes and leaves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rolefinch.functions.matcher import Matcher, required
from rolefinch.functions.taxonomy import load

TAKES = [
    ("Go", "Half of the backend is Go."), ("Go", "GOLANG or similar"), ("Go", "golang on the server"), ("Go", "You know Go, Zig or Nim"), ("Go", "The Go-Around team"), ("React", "a React codebase"), ("React", "ReactJS and friends"), ("React", "pages in REACT.js"),
    ("REST APIs", "our public REST interface"), ("REST APIs", "a Restful service"), ("REST APIs", "restful by design"), ("Spring", "SPRING BOOT and Maven"), ("Spring", "springboot jobs"), ("Spring", "years of Spring, mostly"), ("Machine learning", "an ML platform"),
    ("Machine learning", "MACHINE LEARNING in anger"), ("Machine learning", "some machine learning"), ("RAG", "a RAG chatbot"), ("RAG", "retrieval-augmented answers"), ("RAG", "Retrieval Augmented search"), ("MCP", "an MCP server"), ("MCP", "the model context protocol"),
    ("AI (umbrella)", "AI, mostly"), ("AI (umbrella)", "artificial intelligence lab"), ("AI (umbrella)", "Artificial Intelligence"), (".NET/ASP.NET", "written for .NET 8"), (".NET/ASP.NET", "asp.net pages"), ("JavaScript", "java script or so"), ("JavaScript", "plain JAVASCRIPT"),
    ("Java", "Java 21"), ("SQL (language)", "ad-hoc SQL"), ("Kubernetes", "k8s on bare metal"), ("CI/CD", "a CICD setup"), ("CI/CD", "continuous delivery"), ("CI/CD", "Continuous Deployment"), ("OpenTelemetry", "OTEL collectors"), ("Pub/Sub", "pubsub topics"),
    ("Vector DBs", "a vector store"), ("Vector DBs", "Milvus at scale"), ("Vector DBs", "ChromaDB"), ("NoSQL (word)", "No SQL shops"), ("Bash/Shell", "shell scripts"), ("Express.js", "ExpressJS routes"), ("AWS Lambda", "many lambda handlers"), ("AWS Lambda", "a Lambda per route"),
    ("C++", "modern c++20"), ("C#", "C# and F#"), ("Node.js", "NodeJS"), ("Vue", "vuejs"), ("PostgreSQL", "postgres 16"), ("LLMs", "large language models"), ("LLMs", "an LLM"), ("Generative AI", "GenAI features"), ("Fine-tuning", "fine tuned weights"), ("Low latency / high throughput", "low-latency paths"),
]
LEAVES = [
    ("Go", "Go live by Friday"), ("Go", "Go beyond what is asked"), ("Go", "let us go"), ("Go", "an ego-free team"), ("React", "we react fast"), ("React", "they react.  js is not meant"), ("REST APIs", "have a rest"), ("REST APIs", "for the rest, see below"), ("Spring", "Spring 2031 intake"),
    ("Spring", "spring cleaning"), ("Machine learning", "YAML files"), ("Machine learning", "250 ml bottles"), ("RAG", "a rag trade"), ("RAG", "DRAGON"), ("MCP", "mcp in lower case"), ("AI (umbrella)", "ai in lower case"), ("AI (umbrella)", "MAIL and OpenAIs"), (".NET/ASP.NET", "planet.net"),
    (".NET/ASP.NET", "mail me at a.net"), ("Java", "JavaScript"), ("SQL (language)", "MySQLs"), ("SQL (language)", "NoSQL"), ("Express.js", "express your view"), ("OpenTelemetry", "a motel"), ("Pub/Sub", "a pub"), ("Rust", "trust"), ("Scala", "scalability"), ("Git", "GitHub"),
]


@pytest.fixture(scope="module")
def bundled():
    return Matcher(tuple((p.name, p.pattern, p.case_sensitive) for p in load().patterns))


@pytest.mark.parametrize("name, text", TAKES)
def test_a_rule_takes(bundled, name, text):
    assert name in bundled.names_in(text)


@pytest.mark.parametrize("name, text", LEAVES)
def test_a_rule_leaves(bundled, name, text):
    assert name not in bundled.names_in(text)


def test_one_pass_equals_searching_every_pattern(bundled):
    rng = random.Random(6)
    pieces = [t for _, t in TAKES + LEAVES] + ["ſpark", "\u212aafka", "DJANGO", "\u0130OS", "ıos", "ÉTL", "", " ", ".", "-", "c+ +", "\n", "x" * 50] + [re.sub(r"\\b|[\\?()|]|\[[^]]*\]", "", p.pattern)[:12] for p in load().patterns]
    for _ in range(3000):
        text = rng.choice(["", " ", "-"]).join(rng.choices(pieces, k=rng.randrange(1, 6)))
        text = rng.choice([str, str.upper, str.title, str.swapcase])(text)
        assert bundled.names_in(text) == sorted(n for n, f in zip(bundled.names, bundled.found) if f(text)), text


def test_words_that_every_match_holds():
    assert required(r"\bnode\.?js\b", True) == [("node", True)] and required(r"(?i:\bgolang\b)|\bGo\b(?!\s+to)", False) == [("golang", True), ("Go", False)]
    assert required(r"a{2}bc+d|x*yz", True) == [("bc", True), ("yz", True)] and required(r"[|)(]ab", True) == [("ab", True)] and required(r"\(ab\|", True) == [("(ab|", True)]
    for unsure in (r"a?", r"x|", r"[ab]+", r".*", r"(?x) a b", r"\w+", "é", r"(a|b?)"):
        assert required(unsure, True) is None


def test_patterns_without_a_sure_word_are_always_searched():
    m = Matcher((("any", r"\d+", False), ("none", r"^$", False), ("word", "tea", False), ("cased", "Tea", True)))
    assert m.names_in("42 TEA") == ["any", "word"] and m.names_in("") == ["none"] and m.names_in("Tea") == ["cased", "word"]


def test_skills_of_a_column_equal_those_by_rlike(spark):
    t = load()
    df = spark.createDataFrame([(x,) for _, x in TAKES + LEAVES] + [(None,), ("",)], "t string").repartition(3)
    rows = df.select("t", t.skills(F.col("t")).alias("a"), t.skills_by_rlike(F.col("t")).alias("b")).collect()
    assert len(rows) == len(TAKES) + len(LEAVES) + 2 and all(r["a"] == r["b"] for r in rows) and any(r["a"] for r in rows)
