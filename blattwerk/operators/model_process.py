"""A model in a process of its own, so that a call that hangs can be ended with all it holds."""

from __future__ import annotations

import json
import os
import socket
import subprocess
import sys
from collections.abc import Callable, Iterable
from multiprocessing.connection import Connection

from pyspark import cloudpickle

Model = Callable[[list[dict]], Iterable[str]]

# A new interpreter: it shares neither locks nor open files with the worker.
_CHILD = """
import json, sys
sys.path[:] = json.loads(sys.argv[2])
from multiprocessing.connection import Connection
from pyspark import cloudpickle
link = Connection(int(sys.argv[1]))
serve, load = cloudpickle.loads(link.recv_bytes())
serve(link, load, int(sys.argv[3]))
"""


def payload(load: Callable[[], Model]) -> bytes:
    """What a process needs to serve a model; made on the driver, where all code is."""
    return cloudpickle.dumps((serve, load))


def end_with(parent: int) -> None:
    """End this process when its parent ends, also in the middle of a call (Linux)."""
    try:
        import ctypes

        ctypes.CDLL(None).prctl(1, 9)
    except (ImportError, AttributeError, OSError):
        return
    if os.getppid() != parent:
        os._exit(1)


def serve(link: Connection, load: Callable[[], Model], parent: int) -> None:
    """Load the model, then answer lists of requests until the link ends."""
    end_with(parent)

    def fault(error: BaseException) -> tuple[str, str]:
        return "fault", f"{type(error).__name__}: {error}"

    try:
        model = load()
    except BaseException as error:
        link.send(fault(error))
        return
    link.send(("ready", None))
    while True:
        try:
            requests = link.recv()
        except EOFError:
            return
        try:
            texts = model(requests)
            if hasattr(texts, "__next__"):
                link.send(("stream", None))
                for text in texts:
                    link.send(("text", str(text or "")))
                link.send(("end", None))
            else:
                link.send(("texts", [str(text or "") for text in texts]))
        except BaseException as error:
            link.send(fault(error))


class Ended(Exception):
    """The process gave no answer in time, or ended, or could not load its model."""


class ModelProcess:
    """One running process. After ``Ended`` it is stopped for good."""

    def __init__(self, code: bytes, limit: float) -> None:
        mine, theirs = socket.socketpair()
        arguments = [str(theirs.fileno()), json.dumps(sys.path), str(os.getpid())]
        self.process = subprocess.Popen(
            [sys.executable, "-c", _CHILD, *arguments], pass_fds=[theirs.fileno()], stdin=subprocess.DEVNULL, stdout=2
        )
        theirs.close()
        self.link = Connection(mine.detach())
        try:
            self.link.send_bytes(code)
            kind, what = self.receive(limit)
        except OSError as error:
            self.stop()
            raise Ended(f"{type(error).__name__}: {error}") from None
        if kind != "ready":
            self.stop()
            raise Ended(what)

    def send(self, requests: list[dict]) -> None:
        try:
            self.link.send(requests)
        except OSError:
            raise self.ended() from None

    def receive(self, limit: float) -> tuple[str, object]:
        """The next message; none within ``limit`` seconds ends the process."""
        try:
            if self.link.poll(limit):
                return self.link.recv()
        except (EOFError, OSError):
            raise self.ended() from None
        self.stop()
        raise Ended(f"TimeoutError: keine Antwort nach {limit:g} s")

    def ended(self) -> Ended:
        code = self.stop()
        return Ended(f"RuntimeError: Modellprozess endete mit {code}")

    def stop(self) -> int:
        """End the process and wait until it is gone."""
        self.link.close()
        if self.process.poll() is None:
            self.process.kill()
        return self.process.wait()


class Worker:
    """An engine's model on this worker, loaded when it is first asked.

    ``silent`` counts the calls without any reply that ended the process, since the
    last reply.
    """

    def __init__(self, code: bytes, load_limit: float) -> None:
        self.code, self.load_limit = code, load_limit
        self.process: ModelProcess | None = None
        self.silent = 0

    def ask(self, requests: list[dict], limit: float) -> tuple[list[str], bool, str | None]:
        """(texts, one by one, fault): replies to the first requests, and why the others have none.

        The limit is for each reply of a model that gives them one by one, else
        for the call.
        """
        texts: list[str] = []
        one_by_one = False
        try:
            if self.process is None:
                self.process = ModelProcess(self.code, self.load_limit)
            self.process.send(requests)
            while True:
                kind, what = self.process.receive(limit)
                if kind == "fault":
                    return texts, one_by_one, what
                if kind == "stream":
                    one_by_one = True
                    continue
                self.silent = 0
                if kind == "text":
                    texts.append(what)
                    continue
                texts = what if kind == "texts" else texts
                break
        except Ended as error:
            self.process = None
            self.silent += 1
            return texts, one_by_one, str(error)
        if len(texts) != len(requests):
            return [], False, f"ValueError: {len(requests)} Anfragen, {len(texts)} Antworten"
        return texts, one_by_one, None
