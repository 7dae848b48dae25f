"""Launching, pausing and resuming applications, with priorities and reports."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import program as programs

RUNNING, PAUSING, AT_BARRIER, COMPLETE, FAILED = "RUNNING", "PAUSING", "AT_BARRIER", "COMPLETE", "FAILED"


@dataclass
class Response:
    succeed: bool
    error_message: str = ""
    application_id: int = -1
    value: object = None


@dataclass
class _App:
    program: programs.Program
    priority: int
    state: str = RUNNING
    barrier: int = -1
    stage: int = 0
    seconds: float = 0.0
    result: dict[str, DataFrame] | None = None
    error: str = ""
    gate: threading.Condition = field(default_factory=threading.Condition)
    thread: threading.Thread | None = None


class Manager:
    """Runs programs in threads of their own, each in a scheduler pool by priority (a lower value goes first)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.apps = spark, {}

    def launch(self, name: str, params: dict | None = None, priority: int = 100, first_barrier: int = -1, inputs: dict | None = None) -> Response:
        if priority < 0:
            return Response(False, "The priority must not be negative.")
        try:
            p = programs.load(name, params)
        except (programs.ProgramError, ImportError) as e:
            return Response(False, str(e))
        app, key = _App(p, priority, barrier=first_barrier), len(self.apps)
        self.apps[key] = app
        app.thread = threading.Thread(target=self._run, args=(key, app, inputs), daemon=True)
        app.thread.start()
        return Response(True, application_id=key)

    def _run(self, key: int, app: _App, inputs) -> None:
        sc, began = self.spark.sparkContext, time.time()
        sc.setLocalProperty("spark.scheduler.pool", f"priority-{app.priority}")
        sc.setJobGroup(f"application-{key}", app.program.name)

        def between(stage: int) -> None:
            with app.gate:
                app.stage, app.seconds = stage, time.time() - began
                if app.state == PAUSING or 0 <= app.barrier <= stage:
                    app.state, app.barrier = AT_BARRIER, -1
                    app.gate.notify_all()
                    app.gate.wait_for(lambda: app.state == RUNNING)
            sc.setLocalProperty("spark.scheduler.pool", f"priority-{app.priority}")

        try:
            app.result = app.program.run(self.spark, inputs, control=between)
            app.state = COMPLETE
        except Exception as e:  # noqa: BLE001
            app.error, app.state = str(e), FAILED
        app.seconds = time.time() - began
        with app.gate:
            app.gate.notify_all()

    def _known(self, key: int) -> _App | Response:
        return self.apps.get(key) or Response(False, "The application id is not valid.")

    def pause(self, key: int, wait: float = 600) -> Response:
        """Stops between loop trips, never between a scatter and its gather."""
        app = self._known(key)
        if isinstance(app, Response):
            return app
        with app.gate:
            if app.state != RUNNING:
                return Response(False, "The application is not running.", key)
            app.state = PAUSING
            app.gate.wait_for(lambda: app.state != PAUSING, wait)
        return Response(app.state == AT_BARRIER, "" if app.state == AT_BARRIER else f"The application is {app.state}.", key)

    def resume(self, key: int) -> Response:
        app = self._known(key)
        if isinstance(app, Response):
            return app
        with app.gate:
            if app.state != AT_BARRIER:
                return Response(False, "The application is not paused.", key)
            app.state = RUNNING
            app.gate.notify_all()
        return Response(True, application_id=key)

    def prioritise(self, key: int, priority: int) -> Response:
        app = self._known(key)
        if isinstance(app, Response):
            return app
        if priority < 0:
            return Response(False, "The priority must not be negative.", key)
        app.priority = priority
        return Response(True, application_id=key)

    def report(self, key: int) -> Response:
        app = self._known(key)
        return app if isinstance(app, Response) else Response(True, application_id=key, value={"state": app.state, "stage": app.stage, "seconds": app.seconds, "error": app.error})

    def workers(self) -> Response:
        t = self.spark.sparkContext.statusTracker()
        return Response(True, value={"active_jobs": list(t.getActiveJobsIds()), "active_stages": list(t.getActiveStageIds())})

    def result(self, key: int, wait: float = 600) -> dict[str, DataFrame]:
        app = self.apps[key]
        app.thread.join(wait)
        if app.state != COMPLETE:
            raise RuntimeError(app.error or f"application {key} is {app.state}")
        return app.result
