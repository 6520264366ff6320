import pytest

from quire.functions.paths import relative, resolve_path
from quire.operators import links as L
from quire.operators import selection as S
from quire.operators import state as K
from quire.plans.completer import Client, ModelError, Unreachable, retry_delay
from quire.plans.settings import Settings, confirmation_needed, is_local_endpoint


@pytest.mark.parametrize("expression,expected", [("all", list(range(1, 13))), ("1, 4-6,4", [1, 4, 5, 6]), ("10-", [10, 11, 12])])
def test_grammar(expression, expected):
    assert S.parse_indices(expression, 12) == expected


@pytest.mark.parametrize("expression", ["0", "13", "5-3", "-4", "1,,2", "1--3", "x"])
def test_bad_grammar(expression):
    with pytest.raises(ValueError):
        S.parse_indices(expression, 12)


ROWS = [(1, "Copyright", True), (2, "About Queues", False), (3, "Delivery", False)]


def test_algebra():
    assert S.resolve(ROWS, everything=True) == [2, 3]
    assert S.resolve(ROWS, titles=["queue"]) == [2]
    assert S.resolve(ROWS, "1-3", exclude="2", skip_front_matter=False) == [1, 3]
    for bad in ({"titles": ["e"]}, {"everything": True, "exclude": "all"}, {"indices": "1"}):
        with pytest.raises(ValueError):
            S.resolve(ROWS, **bad)


def test_settings_precedence_and_checks():
    s = Settings.load({"model": "m", "timeout": None}, {"LLM_TIMEOUT": "5", "LLM_API_KEY": "k", "LLM_MODEL": "e"})
    assert (s.model, s.timeout, s.max_tokens, s.vision_model) == ("m", 5.0, 8192, "m") and "api_key" not in repr(s)
    for bad in ({}, {"LLM_API_KEY": "k", "LLM_TIMEOUT": "x"}, {"LLM_API_KEY": "k", "LLM_BASE_URL": "http://u:p@h/v1"}, {"LLM_API_KEY": "k", "LLM_LANGUAGE": "de"}, {"LLM_API_KEY": "k", "LLM_TEMPERATURE": "3"}):
        with pytest.raises(ValueError):
            Settings.load({}, bad)


@pytest.mark.parametrize("url,expected", [("http://localhost:11434/v1", True), ("https://127.0.0.1:11434/v1/", True), ("http://[::1]:11434/v1", True), ("http://localhost:1/v1", False), ("http://localhost:x/v1", False), ("http://a@localhost:11434/v1", False), ("http://localhost:11434/v1?q=1", False), ("http://other:11434/v1", False)])
def test_local_endpoints(url, expected):
    assert is_local_endpoint(url) is expected


def test_prices():
    local = Settings(base_url="http://localhost:11434/v1", model="m", vision_model="m-cloud")
    assert local.local() and not local.local(True) and local.priced() and not local.priced(True) and local.cost(100, 20) == 0
    paid = Settings(input_price=10, output_price=50, language="en")
    assert paid.cost(80, 20, mode="full") == pytest.approx((100 * 10 + 80 * 50) / 1e6)
    assert confirmation_needed(True, False, False) and not confirmation_needed(True, True, False)


def test_paths():
    assert resolve_path("OEBPS/a/b.xhtml", "../c%20d.png#x") == "OEBPS/c d.png"
    assert relative("OEBPS/a/b.xhtml", "OEBPS/c d.png") == "../c%20d.png"


def test_rewrite_links():
    body = '<a href="b.xhtml#x">1</a><a href="b.xhtml#no">2</a><a href="old.xhtml">3</a><a href="fig.png">4</a><a href="http://e">5</a><a href="#x">6</a>'
    out = L.rewrite_links(body, "t/a.xhtml", "t/o.xhtml", {"t/b.xhtml": "t/c.xhtml", "t/a.xhtml": "t/o.xhtml"}, {"t/old.xhtml"}, {"t/fig.png", "t/old.xhtml"}, {"t/c.xhtml": {"x"}, "t/o.xhtml": {"x"}})
    assert out == '<a href="c.xhtml#x">1</a><a href="c.xhtml">2</a>3<a href="fig.png">4</a><a href="http://e">5</a><a href="o.xhtml#x">6</a>'


def test_client_negotiates_and_waits():
    answers = [(400, {}, '{"error": "use max_completion_tokens"}'), (400, {}, '{"error": "temperature unsupported"}'), (429, {"Retry-After": "2"}, ""), (503, {}, ""), (200, {}, '{"usage": {"prompt_tokens": 3, "completion_tokens": 4}, "choices": [{"finish_reason": "stop", "message": {"content": "hi"}}]}')]
    slept, sent = [], []

    def transport(url, headers, body, timeout):
        sent.append(body)
        return answers[len(sent) - 1]

    c = Client(Settings(api_key="k"), transport, slept.append)
    assert c.complete([]) == "hi" and len(sent) == 5 and slept[0] == 2 and (c.input_tokens, c.output_tokens) == (3, 4)
    assert b"max_completion_tokens" in sent[4] and b"temperature" not in sent[4]


@pytest.mark.parametrize("answer", [(401, {}, ""), (200, {}, "no json"), (200, {}, '{"choices": [{"finish_reason": "length", "message": {"content": "x"}}]}'), (200, {}, '{"choices": [{"message": {"content": " "}}]}')])
def test_client_errors(answer):
    with pytest.raises(ModelError):
        Client(Settings(), lambda *a: answer, lambda s: None).complete([])


def test_client_gives_up():
    def fail(*a):
        raise Unreachable

    with pytest.raises(ModelError):
        Client(Settings(), fail, lambda s: None).complete([])


def test_retry_delay():
    assert retry_delay("3", 0) == 3 and retry_delay("-1", 0) == 0 and 4 <= retry_delay("soon", 2) <= 5 and retry_delay("99999", 0) == 600
    assert retry_delay("Wed, 21 Oct 2015 07:28:00 GMT", 0) == 0


def test_state_store(spark, tmp_path):
    store = K.StateStore(spark, str(tmp_path))
    from pyspark.sql import functions as F

    for n, v in enumerate(("a", "b")):
        store.write("responses", spark.createDataFrame([("k", v)], "key string, value string"), F.lit(n))
        store.write("glossary", spark.createDataFrame([("s", "t", v)], "scope string, term string, rendering string"), F.lit(n))
    assert store.read("responses").first()["value"] == "b" and store.read("glossary").first()["rendering"] == "a"
    assert K.StateStore(spark, str(tmp_path), False).read("responses").count() == 0 and store.read("captions").count() == 0
    store.compact("responses", str(tmp_path / "c"))
    assert K.StateStore(spark, str(tmp_path / "c")).read("responses").count() == 1


def test_integrity_and_stream(spark, tmp_path):
    f = lambda rows, cols: spark.createDataFrame(rows, cols)
    nav = f([(1, "a", "x"), (1, "b", None)], "book_id int, path string, fragment string")
    out = L.integrity(nav, f([(1, "a"), (1, "c")], "book_id int, path string"), f([(1, "z")], "book_id int, path string"), f([(1, "a")], "book_id int, path string"), f([(1, "a", "y")], "book_id int, path string, id string"))
    assert sorted((r["problem"], r["path"]) for r in out.collect()) == [("manifest resource", "z"), ("nav anchor", "a"), ("nav target", "b"), ("unreachable spine", "c")]
    from quire.streaming import state_log

    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "k int, seq int, v string").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("k int, seq int, v string").parquet(str(tmp_path / "in"))
    state_log.feed(events, ["k"], "seq", ["v"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r["k"]: r["v"] for r in state_log.current(spark, str(tmp_path / "out"), ["k"], "seq", ["v"]).collect()} == {1: "b", 2: "c"}


def test_dotenv_is_the_last_layer(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text('# keys\nexport LLM_API_KEY="k"\nLLM_MODEL=from-file # x\nLLM_TIMEOUT=7\n')
    monkeypatch.setenv("LLM_TIMEOUT", "9")
    monkeypatch.delenv("LLM_API_KEY", raising=False)
    monkeypatch.delenv("LLM_MODEL", raising=False)
    s = Settings.load({}, dotenv=tmp_path / ".env")
    assert (s.api_key, s.model, s.timeout) == ("k", "from-file", 9.0)
    with pytest.raises(ValueError):
        Settings.load({}, dotenv=tmp_path / "none")
