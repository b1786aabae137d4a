"""DataFrame -> DataFrame operators (evaluation, monitoring, WOE, profiling...)."""
