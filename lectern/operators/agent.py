"""A question-answering loop over the store with an injected language model, and the same steps over recorded transcripts."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import DEFAULT, Settings
from lectern.functions.embedding import hash_vector
from lectern.functions.text import CONTEXT_SUFFIX, citations, percent
from lectern.operators import search, store

# The marks of the model's output, the tools that return content, and messages.
ACTION = r"Action:\s*(\w+)"
ACTION_INPUT = r"(?s)Action Input:\s*(\{.*?\})"
FINAL_ANSWER = r"(?s)Final Answer:\s*(.*)"
CONTENT_TOOLS = ["search_all_documents", "search_document", "read_chunk"]
CITATION = r"chk_[0-9a-f]{6,}"
REMOVED = "[unverified citation removed]"
PREMATURE = (
    "Error: You attempted a Final Answer before searching the knowledge base. You must not answer from your own knowledge. "
    "Call search_all_documents (or search_document) first and base your answer only on the Observations."
)
MALFORMED = "Error: Your output did not follow the required format. You must output 'Action:' and 'Action Input:' OR 'Final Answer:'."
TIMEOUT = "Agent timed out. I was unable to retrieve sufficient information in time to answer your question."


def parse_transcript(steps: DataFrame, text_col: str = "llm_raw_response") -> DataFrame:
    """Append ``tool``, ``tool_input`` and ``final_answer``; null where a response has none."""

    def part(pattern: str):
        return F.when(F.col(text_col).rlike(pattern), F.regexp_extract(text_col, pattern, 1))

    return steps.withColumn("tool", part(ACTION)).withColumn("tool_input", part(ACTION_INPUT)).withColumn("final_answer", F.trim(part(FINAL_ANSWER)))


# What a response is, by whether it names a tool with its input, whether it answers, and whether content was retrieved before.
STEP_TYPES = {
    (acts, answers, retrieved): "final_answer" if answers and retrieved else "action" if acts else "premature_final_answer" if answers else "malformed"
    for acts in (True, False) for answers in (True, False) for retrieved in (True, False)
}


def type_steps(parsed: DataFrame, run: str = "run_id", order: str = "iteration", observation: str = "observation") -> DataFrame:
    """Append ``has_retrieved`` (a content tool succeeded earlier in the run) and ``step_type``, see STEP_TYPES."""
    acts, answers = F.col("tool").isNotNull() & F.col("tool_input").isNotNull(), F.col("final_answer").isNotNull()
    ok = F.col("tool").isin(CONTENT_TOOLS) & F.col("tool_input").isNotNull() & ~F.coalesce(F.col(observation).startswith("Error"), F.lit(True))
    before = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    kinds = F.create_map(*[F.lit(x) for case, kind in STEP_TYPES.items() for x in ("".join("01"[c] for c in case), kind)])
    gated = parsed.withColumn("has_retrieved", F.coalesce(F.max(ok).over(before), F.lit(False)))
    return gated.withColumn("step_type", kinds[F.concat(*[c.cast("int").cast("string") for c in (acts, answers, F.col("has_retrieved"))])])


def validate_citations(answers: DataFrame, chunks: DataFrame, key: str = "answer_id", answer: str = "answer") -> DataFrame:
    """Append ``cleaned`` and ``unverified`` (sorted array): cited chunk ids that don't exist are replaced, each as a whole id."""
    cited = answers.select(key, F.explode(citations(F.col(answer))).alias("chunk_id"))
    missing = cited.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
    lists = missing.groupBy(key).agg(F.array_sort(F.collect_set("chunk_id")).alias("unverified"))
    joined = answers.join(lists, key, "left").withColumn("unverified", F.coalesce("unverified", F.array().cast("array<string>")))
    cleaned = F.aggregate("unverified", F.col(answer), lambda text, bad: F.regexp_replace(text, F.concat(bad, F.lit("(?![0-9a-f])")), F.lit(REMOVED.replace("[", r"\[").replace("]", r"\]"))))
    return joined.withColumn("cleaned", cleaned)


@dataclass(frozen=True)
class Tool:
    """What a model can call: ``run`` maps the input to an answer (text, or what becomes JSON); ``needs`` must be in the input."""

    usage: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()

    def call(self, given: str) -> str:
        """The observation; whatever goes wrong begins with "Error"."""
        try:
            found = json.loads(given)
            if lacking := [n for n in self.needs if not found.get(n)]:
                return f"Error: the input lacks {' and '.join(lacking)}. Usage: {self.usage}"
            answer = self.run(found)
        except json.JSONDecodeError as e:
            return f"Error: the input can't be read as JSON ({e.msg} at {e.pos}): {given}"
        except Exception as e:
            return f"Error: the call failed with {type(e).__name__}: {e}"
        return answer if isinstance(answer, str) else json.dumps(answer, indent=2)


def library_tools(files: DataFrame, chunks: DataFrame, embed: Callable[[str], list[float]], k: int = 4, page: int = 100) -> dict[str, Tool]:
    """The tools over a library's files and chunks. Listings come in pages, searches give ``k`` chunks."""
    named = chunks.withColumnRenamed("id", "chunk_id")

    def listing(given: dict) -> object:
        rows = store.list_documents(files)
        if last := given.get("after"):
            rows = rows.where((F.col("title") > last[0]) | ((F.col("title") == last[0]) & (F.col("id") > last[1])))
        found = [r.asDict() for r in rows.orderBy("title", "id").limit(page + 1).collect()]
        if len(found) <= page:
            return found or "Nothing is stored here" + (" after that." if last else "; documents must be added first.")
        end = found[page - 1]
        return json.dumps(found[:page], indent=2) + f"\nThere are more: ask with {json.dumps({'after': [end['title'], end['id']]})}"

    def shown(hits: DataFrame, *names: str) -> list[dict]:
        rows = hits.select(*names, F.col("text_data").alias("text"), percent(F.col("similarity")).alias("similarity_score"))
        return [r.asDict() for r in rows.collect()]

    def everywhere(given: dict) -> object:
        return shown(search.search_all(named, files, embed(given["query"]), k), "chunk_id", "document_title")

    def within(given: dict) -> object:
        document = store.resolve(files, given["file_id"]).first()
        if document is None:
            raise LookupError(f"no document has the id or a title like {given['file_id']!r}; list_documents shows them")
        return shown(search.top_k(named, embed(given["query"]), k, document.id), "chunk_id")

    def one(given: dict) -> object:
        row = store.read_chunk(chunks, given["chunk_id"]).first()
        if row is None:
            raise LookupError(f"there is no chunk {given['chunk_id']!r}")
        return row.asDict()

    return {
        "list_documents": Tool('list_documents: titles and ids, a page at a time. Input: {} or {"after": [title, id]}', listing),
        "search_all_documents": Tool('search_all_documents: passages of any document by meaning. Input: {"query": "..."}', everywhere, ("query",)),
        "search_document": Tool('search_document: passages of one document, by its id or title. Input: {"query": "...", "file_id": "..."}', within, ("query", "file_id")),
        "read_chunk": Tool('read_chunk: the whole text of a passage. Input: {"chunk_id": "..."}', one, ("chunk_id",)),
    }


@dataclass
class Agent:
    """The loop. ``llm`` maps (instruction, context) to a response; ``embed`` a question to its vector; ``tools`` add to the library's."""

    spark: SparkSession
    files: DataFrame
    chunks: DataFrame
    llm: Callable[[str, str], str]
    embed: Callable[[str], list[float]] | None = None
    settings: Settings = DEFAULT
    require_rows: bool = False
    tools: dict[str, Tool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        embed = self.embed or (lambda text: hash_vector(text, self.settings.dim))
        self.tools = library_tools(self.files, self.chunks, embed) | self.tools

    def instruction(self) -> str:
        listed = "\n".join(f"- {tool.usage}" for tool in self.tools.values())
        return (
            "Answer from the documents only. Search before you answer and cite chunk ids that you were shown.\n"
            "To use a tool write\nAction: tool name\nAction Input: {JSON}\nTo answer write\nFinal Answer: text\n"
            f"Tools:\n{listed}\n"
        )

    def step(self, response: str, retrieved: bool) -> dict:
        """What a response is and leads to: ``type``, and ``content`` of an answer or ``observation`` of anything else."""
        parts = {name: found[1] for name, p in (("tool", ACTION), ("input", ACTION_INPUT), ("answer", FINAL_ANSWER)) if (found := re.search(p, response))}
        kind = STEP_TYPES["tool" in parts and "input" in parts, "answer" in parts, retrieved]
        if kind == "final_answer":
            return {"type": kind, "content": parts["answer"].strip()}
        if kind != "action":
            return {"type": kind, "observation": PREMATURE if kind == "premature_final_answer" else MALFORMED}
        name = parts["tool"]
        seen = self.tools[name].call(parts["input"]) if name in self.tools else f"Error: no tool goes by {name}; there are {', '.join(self.tools)}"
        return {"type": kind, "tool": name, "input": parts["input"], "observation": seen}

    def opens_gate(self, step: dict) -> bool:
        """Whether a step brought content, so that an answer may follow; with ``require_rows`` an empty result is none."""
        seen = step.get("observation", "Error")
        return step.get("tool") in CONTENT_TOOLS and not seen.startswith("Error") and not (self.require_rows and seen.strip() in ("[]", "{}", ""))

    def run(self, query: str) -> tuple[str, list[dict]]:
        """(answer, steps); at most ``agent_max_iterations`` responses."""
        said, steps = [f"Question: {query}\n"], []
        most = self.settings.agent_max_iterations
        while len(steps) < most:
            response = self.llm(self.instruction(), "".join(said))
            steps.append({"iteration": len(steps), "llm_raw_response": response} | self.step(response, any(map(self.opens_gate, steps))))
            if "content" in steps[-1]:
                return steps[-1]["content"], steps
            seen, room = steps[-1]["observation"], self.settings.observation_chars
            said.append(f"\n{response}\nObservation: {seen if len(seen) <= room else seen[:room] + CONTEXT_SUFFIX}\n")
        steps.append({"iteration": most, "llm_raw_response": None, "type": "timeout", "content": TIMEOUT})
        return TIMEOUT, steps

    def ask(self, query: str) -> dict:
        """The answer with its unknown citations removed, the steps, and those citations."""
        answer, steps = self.run(query)
        one = self.spark.createDataFrame([(0, answer)], "answer_id int, answer string")
        row = validate_citations(one, self.chunks).first()
        return {"query": query, "answer": row.cleaned, "steps": steps, "unverified_citations": list(row.unverified)}


def chat(url: str, model: str, key: str = "", style: str = "openai", post=None, attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> Callable[[str, str], str]:
    """A language model behind HTTP in the style of openai, gemini or ollama. Only 429 answers of the first are tried again."""
    from lectern.functions.embedding import ProviderError, _post

    def call(instruction: str, context: str) -> str:
        if style == "gemini":
            target, headers = f"{url}/models/{model}:generateContent", {"x-goog-api-key": key}
            body = {"systemInstruction": {"parts": [{"text": instruction}]}, "contents": [{"role": "user", "parts": [{"text": context}]}]}
        elif style == "ollama":
            target, headers, body = f"{url}/api/generate", {}, {"model": model, "system": instruction, "prompt": context, "stream": False}
        elif style == "openai":
            target, headers = f"{url}/chat/completions", {"Authorization": f"Bearer {key}"}
            body = {"model": model, "messages": [{"role": "system", "content": instruction}, {"role": "user", "content": context}]}
        else:
            raise ValueError(f"unknown style: {style}")
        for attempt in range(attempts):
            status, answer = (post or _post)(target, headers, body)
            if status < 400:
                if style == "gemini":
                    return answer["candidates"][0]["content"]["parts"][0]["text"]
                return answer["response"] if style == "ollama" else answer["choices"][0]["message"]["content"]
            if style != "openai" or status != 429 or attempt == attempts - 1:
                raise ProviderError(f"HTTP {status}: {answer}")
            advice = re.search(r"try again in ([0-9.]+)s", json.dumps(answer))
            wait(float(advice[1]) + 1 if advice else 2.0**attempt)
        raise AssertionError

    return call
