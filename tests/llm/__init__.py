"""Tests of the corpus operators; a package, so that its modules may be named as those above."""
