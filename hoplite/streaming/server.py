"""A socket in front of `service.answer`: one connection after the other, one request each, then it is closed.

The socket lives on the driver; every count is a job over the distributed edges. A request that fails is
logged and its connection closed; the server goes on.
"""

from __future__ import annotations

import logging
import socket

from pyspark.sql import DataFrame

from hoplite.operators.service import answer

#: Bytes read of a request, and connections that wait (fixed values).
REQUEST_BYTES, BACKLOG = 1 << 16, 5
log = logging.getLogger(__name__)


class RequestServer:
    def __init__(self, edges: DataFrame, port: int = 8080, host: str = "", direction: str = "out", patience: float = 5.0):
        self.edges, self.direction, self.patience = edges, direction, patience
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_STREAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((host, port))
        self.socket.listen(BACKLOG)
        self.port = self.socket.getsockname()[1]

    def __enter__(self) -> "RequestServer":
        return self

    def __exit__(self, *_error) -> None:
        self.socket.close()

    def _received(self, connection: socket.socket) -> str:
        """The request up to the length that it states, or its head where it states none."""
        data = b""
        while len(data) < REQUEST_BYTES:
            part = connection.recv(REQUEST_BYTES - len(data))
            data += part
            head, found, body = data.partition(b"\r\n\r\n")
            stated = [x.split(b":", 1)[1] for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
            if not part or (found and len(body) >= int(stated[0] if stated else 0)):
                break
        return data.decode("utf-8", "replace")

    def serve_one(self) -> None:
        connection, _ = self.socket.accept()
        with connection:
            connection.settimeout(self.patience)
            try:
                raw = self._received(connection)
                spark = self.edges.sparkSession
                response = answer(spark.createDataFrame([(0, raw)], "req long, raw string"), self.edges, self.direction).first()["response"]
                connection.sendall(response.encode())
            except Exception:
                log.exception("a request failed")

    def serve_forever(self) -> None:
        while True:
            self.serve_one()
