"""Error types raised on the driver."""


class IterationError(Exception):
    """A search with a bounded number of tries found nothing."""


class NotMeaningfulError(Exception):
    """An operation has no meaning for its operands, such as ordering alleles."""


class SimulationError(Exception):
    """A simulation cannot meet its constraints."""


class FileFormatError(Exception):
    """A file does not follow its format."""
