"""Named queries; importing this package registers all of them."""

from flowgauge.plans.queries import (detection, drift, encoding, evaluation, preparation,  # noqa: F401
                                     sampling, state, synthesis)
