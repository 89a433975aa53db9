"""Typed errors: every failure the library reports on purpose."""


class FlowGaugeError(Exception):
    """Base of all errors raised here."""


class MissingLabel(FlowGaugeError):
    """The table has no label column."""


class MissingFeatures(FlowGaugeError):
    """Fitted features are absent from the table to be aligned."""

    def __init__(self, names):
        self.names = sorted(names)
        super().__init__(f"missing features: {', '.join(self.names)}")


class NoFeatures(FlowGaugeError):
    """A projection or a cleaning step left no feature column."""


class NoKnownLabels(FlowGaugeError):
    """No row carries a label of the fitted dictionary."""


class NotFitted(FlowGaugeError):
    """Fitted parameters were asked for where none are saved."""


class HeaderMismatch(FlowGaugeError):
    """Files read together do not share one header line."""


class NameCollision(FlowGaugeError):
    """Several columns of a table are spellings of one canonical name."""

    def __init__(self, clashes):
        self.clashes = clashes
        super().__init__("; ".join(f"{name}: {', '.join(columns)}" for name, columns in sorted(clashes.items())))
