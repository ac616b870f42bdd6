"""Sheet, segment, topology, text, scale, room and phase operators."""
