"""Query plans: the registered catalogue and the end-to-end studies."""
