"""The same operators on streams: state where the batch uses windows."""
