import json
import socket
import threading
import urllib.error
import urllib.request

import pytest

from tessera import server, service


class Engine:
    gate = service.AdmissionGate()
    timeout = 5.0


class App(server.App):
    """Answers without a session."""

    def __init__(self):
        super().__init__(Engine(), "mirror")
        self.cancelled, self.hold = threading.Event(), threading.Event()

    def source(self, name):
        return "# Text" if name == "data/processed/p/b/a b.md" else None

    def asset(self, name):
        return b"png" if name == "p/x.png" else None

    def cancel(self, tag):
        self.cancelled.set()
        self.hold.set()

    def query(self, request, tag):
        if request["question"] == "no index":
            raise FileNotFoundError("no index under data/index")
        if request["question"] == "broken":
            raise RuntimeError("out of luck")
        return {"answer": request["question"], "citations": []}

    def complete(self, request, tag):
        said = request["messages"][-1]["content"]
        if said == "full":
            raise service.Busy(15)
        if said == "late":
            raise TimeoutError("no answer within 1 s")
        if said == "wait":
            self.hold.wait(20)
            raise ConnectionError
        return {"object": "chat.completion", "choices": [{"message": {"role": "assistant", "content": said * 150}}]}


@pytest.fixture
def running():
    app = App()
    with server.make_server(app, port=0) as web:
        threading.Thread(target=web.serve_forever, daemon=True).start()
        yield app, f"http://127.0.0.1:{web.server_address[1]}", web.server_address
        web.shutdown()


def ask(base, path, payload=None):
    data = None if payload is None else payload if isinstance(payload, bytes) else json.dumps(payload).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(base + path, data), timeout=20) as got:
            return got.status, got.headers, got.read()
    except urllib.error.HTTPError as failed:
        return failed.code, failed.headers, failed.read()


def said(text, **more):
    return {"messages": [{"role": "user", "content": text}], **more}


def test_routes(running):
    _, base, _ = running
    status, _, body = ask(base, "/health")
    assert status == 200 and json.loads(body)["status"] == "ok" and json.loads(body)["admission"]["active"] == 0
    assert json.loads(ask(base, "/v1/models")[2])["data"][0]["object"] == "model"
    assert ask(base, "/v1/sources/p/b/a%20b.md")[2] == b"# Text" and ask(base, "/v1/sources/none.md")[0] == 404
    status, headers, body = ask(base, "/v1/assets/p/x.png")
    assert (status, headers["Content-Type"], body) == (200, "image/png", b"png") and ask(base, "/v1/assets/y.png")[0] == 404
    assert ask(base, "/other")[0] == 404 and ask(base, "/other", {})[0] == 404


def test_completions(running):
    _, base, _ = running
    assert json.loads(ask(base, "/v1/chat/completions", said("a"))[2])["choices"][0]["message"]["content"] == "a" * 150
    status, headers, body = ask(base, "/v1/chat/completions", said("ab", stream=True))
    frames = [service.parse_frame(line) for line in body.decode().splitlines() if line]
    assert status == 200 and headers["Content-Type"] == "text/event-stream" and frames[-1] == "[DONE]"
    assert "".join(f["choices"][0]["delta"].get("content", "") for f in frames[:-1] if "choices" in f) == "ab" * 150
    status, headers, _ = ask(base, "/v1/chat/completions", said("full"))
    assert (status, headers["Retry-After"]) == (503, "15")
    assert ask(base, "/v1/chat/completions", said("late"))[0] == 504
    assert ask(base, "/v1/chat/completions", b"no json")[0] == 400 and ask(base, "/v1/chat/completions", {})[0] == 400


def test_a_client_that_leaves_cancels_its_jobs(running, monkeypatch):
    monkeypatch.setattr(server, "WATCH", 0.05)
    app, _, address = running
    body = json.dumps(said("wait")).encode()
    with socket.create_connection(address) as client:
        client.sendall(b"POST /v1/chat/completions HTTP/1.1\r\nHost: x\r\nContent-Length: %d\r\n\r\n" % len(body) + body)
        assert not app.cancelled.wait(0.3)
    assert app.cancelled.wait(10)


def test_every_request_gets_a_response(running):
    _, base, _ = running
    path = "/v1/chat/completions"
    for wrong in ([], "text", {"messages": None}, {"messages": ["x"]}, {"messages": [{"role": "user", "content": None}]}, {"messages": [{"role": "user", "content": 3}], "stream": True}, {"messages": [], "stream": True}):
        assert ask(base, path, wrong)[0] == 400
    status, _, body = ask(base, "/v1/query", {"question": "why?"})
    assert status == 200 and json.loads(body)["answer"] == "why?"
    assert [ask(base, "/v1/query", {"question": q})[0] for q in ("no index", "broken", "", 5)] == [503, 500, 400, 400]
    assert ask(base, "/v1/query", b"")[0] == 400 and ask(base, "/v1/query", {"q": 1})[0] == 400


def test_a_stream_begins_before_the_answer_is_there(running):
    app, base, address = running
    body = json.dumps(said("wait", stream=True)).encode()
    with socket.create_connection(address) as client:
        client.settimeout(10)
        client.sendall(b"POST /v1/chat/completions HTTP/1.1\r\nHost: x\r\nContent-Length: %d\r\n\r\n" % len(body) + body)
        got = b""
        while b"searching" not in got:
            got += client.recv(4096)
    assert b"200" in got.split(b"\r\n")[0] and not app.hold.is_set()
    app.hold.set()


def test_contents_and_history():
    parts = [{"type": "text", "text": "one"}, {"type": "image_url", "image_url": "x"}, {"type": "text", "text": "two"}]
    last, before = service.last_message({"messages": [{"role": "user", "content": "first"}, {"role": "assistant", "content": None}, {"role": "user", "content": parts}, {"role": "user", "content": " "}]})
    assert last == "one\ntwo" and before == [{"role": "user", "content": "first"}, {"role": "assistant", "content": ""}]
