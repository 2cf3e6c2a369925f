"""Nothing here: the operators covered have no streaming form. The chain is an offline iterative job."""
