"""Error classes; each has the exit code a command line would end with."""


class EngineError(Exception):
    exit_code = 1


class ArgumentError(EngineError, ValueError):
    exit_code = 2


class ParseError(EngineError, ValueError):
    exit_code = 3


class ValidationError(EngineError):
    exit_code = 4


class DuplicateKeyError(EngineError):
    exit_code = 5


class MismatchError(EngineError):
    exit_code = 1


class FilesystemError(EngineError, OSError):
    exit_code = 1
