"""Spans of a job: its stages, nested, with their times, states and row counts, as OTLP JSON."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from .models import TRACERS, Tracer, observed

_STATUS = {"ok": 1, "error": 2}


def _value(x) -> dict:
    """A value in OTLP's form; whole numbers are strings there."""
    if isinstance(x, bool):
        return {"boolValue": x}
    if isinstance(x, int):
        return {"intValue": str(x)}
    return {"doubleValue": x} if isinstance(x, float) else {"stringValue": str(x)}


def _attributes(found: dict) -> list[dict]:
    return [{"key": k, "value": _value(v)} for k, v in found.items() if v is not None]


class SpanTracer(Tracer):
    """Collects spans on the driver; a span opened within another is its child.

    With ``write`` each finished outermost span is handed on, with all within it,
    as one line of OTLP JSON, which collectors take at ``/v1/traces``.
    """

    def __init__(self, write: Callable[[str], object] | None = None, service: str = "askloom"):
        self.write, self.service = write, service
        self.spans: dict[str, dict] = {}
        self.open: list[str] = []
        self.done: list[dict] = []

    def start(self, name: str, **attributes) -> str:
        span = uuid.uuid4().hex[:16]
        parent = self.spans[self.open[-1]] if self.open else None
        self.spans[span] = {
            "traceId": parent["traceId"] if parent else uuid.uuid4().hex, "spanId": span, "parentSpanId": parent["spanId"] if parent else "",
            "name": name, "kind": 1, "startTimeUnixNano": str(time.time_ns()), "attributes": _attributes(attributes), "events": [],
        }
        self.open.append(span)
        return span

    def event(self, trace: str, event: str, **attributes) -> None:
        known = self.spans.get(trace) or next(s for s in reversed(self.done) if s["spanId"] == trace)
        known["events"].append({"timeUnixNano": str(time.time_ns()), "name": event, "attributes": _attributes(attributes)})

    def note(self, trace: str, **attributes) -> None:
        self.spans[trace]["attributes"] += _attributes(attributes)

    def end(self, trace: str, status: str = "ok") -> None:
        while self.open:  # what an error left open within it ends too
            own = self.open.pop()
            span = self.spans.pop(own)
            span |= {"endTimeUnixNano": str(time.time_ns()), "status": {"code": _STATUS[status]}}
            self.done.append(span)
            if own == trace:
                break

    @contextmanager
    def trace(self, name: str, **attributes) -> Iterator[str]:
        span = self.start(name, **attributes)
        try:
            yield span
        except Exception as e:
            self.event(span, "exception", message=str(e)[:1000])
            self.end(span, "error")
            raise
        else:
            self.end(span)
        finally:
            if not self.open and self.write:
                self.write(json.dumps(self.otlp(), ensure_ascii=False))
                self.done = []

    def otlp(self) -> dict:
        """All finished spans, as a request to a collector."""
        resource = {"attributes": _attributes({"service.name": self.service})}
        return {"resourceSpans": [{"resource": resource, "scopeSpans": [{"scope": {"name": "askloom"}, "spans": self.done}]}]}


@contextmanager
def stage(tracer: Tracer | None, name: str, **attributes) -> Iterator[Callable]:
    """A span around a stage; what it yields maps a table and the action that runs it to the action's result.

    The rows that the action computed are counted on the way, without a job of
    their own.  Without a tracer nothing is counted.
    """
    if tracer is None:
        yield lambda df, action: action(df)
        return
    with tracer.trace(name, **attributes) as span:

        def run(df: DataFrame, action: Callable[[DataFrame], object]):
            counted, seen = observed(df, f"{name}-{uuid.uuid4().hex[:8]}")
            out = action(counted)
            if isinstance(tracer, SpanTracer):
                tracer.note(span, rows=seen.get["rows"])
            else:
                tracer.event(span, "rows", rows=seen.get["rows"])
            return out

        yield run


TRACERS["spans"] = SpanTracer
