"""spanforge.streaming"""
