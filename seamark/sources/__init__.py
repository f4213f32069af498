"""Where files, vectors and settings come from and go to."""
