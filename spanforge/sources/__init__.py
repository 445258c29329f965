"""spanforge.sources"""
