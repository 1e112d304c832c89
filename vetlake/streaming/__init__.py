"""An extension: the scorer over a stream of scored rows. The batch operators need none of it."""
