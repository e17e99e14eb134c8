"""Exceptions of the library."""


class WeirError(Exception):
    """Base of all."""


class PipelineBuildError(WeirError):
    """A pipeline can't be built: a bad expression, operator or option."""


class ExpressionError(PipelineBuildError):
    """An expression doesn't parse."""


class ChannelError(WeirError):
    """Base of what channels raise."""


class ChannelClosedError(ChannelError):
    """Sent to a closed channel, or received from a closed and empty one."""


class BufferFullError(ChannelError):
    """The messages don't fit into the channel's capacity."""


class BufferEmptyError(ChannelError):
    """Nothing to receive."""


class MessageTooLargeError(ChannelError):
    """A message needs more slots than the channel has."""


class CorruptedMessageError(ChannelError):
    """A checksum, a frame header or a chunk sequence is wrong."""


class SequenceMismatchError(ChannelError):
    """A sequence number isn't the expected one."""


class UrlError(WeirError, ValueError):
    """A transport URL is wrong; reason says how."""

    def __init__(self, reason: str, url: str):
        super().__init__(f"{reason}: {url!r}")
        self.reason = reason
