"""Streams of answer sheets. The checks of the lint keep no state, so they run on a stream as they are."""
