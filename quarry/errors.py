"""Errors of the engine."""


class EngineError(Exception):
    """A code such as invalid_argument or not_found, a message, and the component that raised it."""

    def __init__(self, code: str, message: str, component: str = ""):
        super().__init__(f"{component}: {message} ({code})" if component else f"{message} ({code})")
        self.code, self.message, self.component = code, message, component
