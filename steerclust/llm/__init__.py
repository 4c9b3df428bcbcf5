"""Training-data operators. Nothing else in the package imports this subpackage; its queries
are listed in ``registry`` and added to the driver contract only when it can be imported."""
